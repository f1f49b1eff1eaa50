import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from concord.llm import ppm, queries
from concord.llm.common import binary_column

DATA = "/root/testdata/sf0.01"


def brute(counts, text):
    """Bits of a text by walking the tree of one language symbol by symbol."""
    bits = 0.0
    for i, s in enumerate(text):
        k = min(3, i)
        while k >= 0:
            seen = counts.get(text[i - k : i], {})
            if seen:
                total = sum(seen.values()) + len(seen)
                if s in seen:
                    bits -= math.log2(seen[s] / total)
                    break
                bits -= math.log2(len(seen) / total)
            k -= 1
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_tree_walk(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der die das und der", "de"), ("the then that", "en"), ("thé", "en"), ("zu der", "de"), (None, "de"), ("x", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.fit(docs)
    assert model.langs == ["de", "en"]
    trees = {}
    for _, t, lang in rows:
        if t and lang:
            b = t.encode()
            for i in range(len(b)):
                for k in range(min(3, i) + 1):
                    seen = trees.setdefault(lang, {}).setdefault(b[i - k : i], {})
                    seen[b[i]] = seen.get(b[i], 0) + 1
    texts = [b"", "der thé zzz".encode(), b"t", b"\xff\x00", b"das und that then" * 50]
    raw, offs = binary_column(pa.array(texts, pa.binary()))
    for piece in (7, 1 << 17):
        ppm.PIECE = piece
        got = ppm.code_lengths(model, raw, offs)
        want = [[brute(trees[x], t) for x in model.langs] for t in texts]
        np.testing.assert_allclose(got, want, rtol=1e-4)
    ppm.PIECE = 1 << 17


def test_many_languages_equal_their_tree_walks(spark):
    rng = random.Random(4)
    letters = [[chr(rng.choice((97, 0x430, 0x4E00, 0x3B1)) + rng.randrange(24)) for _ in range(12)] for _ in range(70)]
    text = lambda i, n: "".join(rng.choices([*letters[i], " "], k=n))
    rows = [(i, text(i % 70, 300), f"l{i % 70:02}") for i in range(140)]
    model = ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == [f"l{i:02}" for i in range(70)] and len(model.blocks) == 9
    trees = {}
    for _, t, lang in rows:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(3, i) + 1):
                seen = trees.setdefault(lang, {}).setdefault(b[i - k : i], {})
                seen[b[i]] = seen.get(b[i], 0) + 1
    texts = [text(i, 200).encode() for i in range(0, 70, 9)]
    got = ppm.code_lengths(model, *binary_column(pa.array(texts, pa.binary())))
    np.testing.assert_allclose(got, [[brute(trees[x], t) for x in model.langs] for t in texts], rtol=1e-4)
    assert [model.langs[i] for i in got.argmin(axis=1)] == [f"l{i:02}" for i in range(0, 70, 9)]


def test_the_query_equals_tree_walks_of_its_whole_table(spark):
    """Languages and scores of all of sf0.001, whose labelled documents are all learnt from, by a walk for each text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees, rows = {}, docs.collect()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            b = r["text"].encode()
            for i in range(len(b)):
                for k in range(min(3, i) + 1):
                    seen = trees.setdefault(r["lang"], {}).setdefault(b[i - k : i], {})
                    seen[b[i]] = seen.get(b[i], 0) + 1
    got = {r["doc_id"]: r for r in queries.op5_ppm_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, text = got[r["doc_id"]], r["text"] or ""
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not any(map(str.isalpha, text)):
            assert (g["lang_pred"], g["score"]) == ("und", 0)
        elif len(text) < 4000:
            bits = {x: brute(trees[x], text.encode()) for x in sorted(trees)}
            least = min(bits.values())
            assert abs(g["score"] - 1 / sum(2 ** -min(1000, b - least) for b in bits.values())) < 1e-2
            assert bits[g["lang_pred"]] - least < 1e-2


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "a"), (1, "the cat", "en", "a"), (None, "der hund", "de", "b"), (3, None, "de", "c"), (4, "", None, None), (5, "12 34 !", None, "d"), (6, "hund " * 40000, None, "e")], "doc_id long, text string, lang string, score string")
    got = ppm.identify(docs, ppm.fit(docs)).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und" and by[3]["score"] == 0
    assert by[6]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got)
    bare = ppm.identify(docs, ppm.fit(docs), columns=["doc_id"])
    assert bare.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(map(str, bare.collect())) == sorted(str(r) for r in ppm.identify(docs, ppm.fit(docs)).select("doc_id", "lang_pred", "score").collect())
    empty = docs.limit(0)
    assert ppm.identify(empty, ppm.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(docs, ppm.fit(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = ppm.fit(docs.where(ppm.trainable()))
    told = ppm.identify(docs, model).where(~ppm.trainable() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    right, all_ = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / all_ > 0.97
