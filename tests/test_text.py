import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.functions import text as T


def general(text):
    """The definition, character by character."""
    text = unicodedata.normalize("NFKC", text or "").casefold().replace("&", " and ")
    out = ""
    for c in text:
        out += c if c.isalnum() or unicodedata.category(c).startswith("M") else " "
    return " ".join(out.split())


def fold(text):
    out, base = "", ""
    for c in unicodedata.normalize("NFD", text):
        mark = unicodedata.category(c).startswith("M")
        base = base if mark else c
        if not (mark and base and "LATIN" in unicodedata.name(base, "")):
            out += c
    return unicodedata.normalize("NFC", out)


def views(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    n = df.select("i", "x", T.conservative(F.col("x")).alias("n"))
    return n.select("i", "n", T.accent_fold(F.col("n")).alias("a"), T.core(F.col("n")).alias("core"), T.suffix(F.col("n")).alias("suffix"), T.standardized(F.col("n")).alias("s"), T.numbers(F.col("n")).alias("d")).orderBy("i").collect()


def test_examples(spark):
    got = views(spark, ["Sharma Textiles Private Limited", "Acme Incorporated", "Smith & Sons, Inc.", "école", "मार्केटिंग", "12/7 Market St., 560001", None, "", "inc ltd", "inc", "_a_b_", "10 rd ave"])
    assert [r["core"] for r in got[:2]] == ["sharma textiles", "acme"] and got[0]["suffix"] == "private limited"
    assert got[2]["n"] == "smith and sons inc" and got[3]["a"] == "ecole" and got[4]["a"] == got[4]["n"] == "मार्केटिंग"
    assert got[5]["d"] == ["12", "7", "560001"] and got[5]["s"] == "12 7 market street 560001"
    assert got[6]["n"] == got[7]["n"] == "" and got[7]["core"] == "" and got[7]["d"] == []
    assert (got[8]["core"], got[8]["suffix"]) == ("inc", "ltd") and (got[9]["core"], got[9]["suffix"]) == ("inc", "")
    assert got[10]["n"] == "a b" and got[11]["s"] == "10 road avenue"


def test_every_character_in_context(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF and (p < 0x3000 or p % 61 == 0)]
    values = [f"a{chr(p)}b" for p in points] + [f"{chr(p)}́" for p in points]
    for value, row in zip(values, views(spark, values), strict=True):
        assert row["n"] == general(value) and row["a"] == fold(general(value))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_plain_functions_follow_the_definition(text):
    assert T.conservative_text(text) == general(text)
    assert T.accent_fold_text(general(text)) == fold(general(text))


def test_name_and_address_structs(spark):
    row = spark.createDataFrame([("Ünal & Co Ltd", "5 Main St")], "n string, a string").select(T.name_views(F.col("n")).alias("n"), T.address_views(F.col("a")).alias("a")).first()
    assert row["n"].asDict() == {"raw": "Ünal & Co Ltd", "normalized": "ünal and co ltd", "accent_folded": "unal and co ltd", "core": "ünal and co", "suffix": "ltd"}
    assert row["a"].asDict() == {"raw": "5 Main St", "normalized": "5 main st", "accent_folded": "5 main st", "standardized": "5 main street", "numbers": ["5"]}
