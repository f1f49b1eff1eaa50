import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from concord.llm import mixing, ppm, simhash, unigram

from .test_minhash import plain_groups
from .test_pii_documents import plain_documents

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "", None, "src1", 0), (90_003, "12 34", "de", None, 5), (90_004, "the the cat " * 9 + "mail x@y.co", "en", None, 119)], docs.schema)
    docs = docs.union(more)
    columns, out = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs, (docs := spark.read.parquet(path))
        assert k == len(cp.STAGES) - 1 or docs.columns == columns

    before, after = out["language_id"]
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in ppm.identify(before, ppm.fit(before.where(ppm.trainable()))).collect()}
    assert {r["doc_id"]: r["lang"] for r in after.collect()} == {d: lang for d, (lang, s) in told.items() if lang != "und" and s >= 0.5}
    assert before.count() - after.count() < 10

    before, after = out["near_duplicates"]
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before.collect()])  # true shingle similarity of all pairs
    assert {r["doc_id"] for r in after.collect()} == {d for d, least in groups.items() if d == least} != set(groups)

    before, after = out["personal_data"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    labels = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "")
    for (d, text), (_, spans) in zip(rows, plain_documents(rows), strict=True):
        merged = []
        for s, k, e, _ in spans:
            if merged and merged[-1][1] > s:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in reversed(merged):
            text = text[:s] + labels[k] + text[e:]
        assert got[d] == (text, len(text))
    assert not any(re.search(r"\w@\w+\.\w", t) for t, _ in got.values())

    before, after = out["mixture"]
    lines = mixing.plan(before, max_repeats=2.0)
    copies = Counter(r["doc_id"] for r in after.collect())
    assert set(copies) == {r["doc_id"] for r in before.collect()} and max(copies.values()) <= 3
    total = lines.agg(F.sum("budget")).first()[0]
    assert after.agg(F.sum(mixing.tokens_of(F.col("text")))).first()[0] <= total * 1.01

    before, after = out["pieces"]
    vocab = unigram.load(cp.VOCABULARY)
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    pieces = after.collect()
    assert len(pieces) == before.count() and all(unigram.decode_ids(vocab, r["ids"]) == text[r["doc_id"]] for r in pieces)


def test_stages_on_empty_tables_nulls_repeats_and_clashing_names(spark):
    names = ["__lang", "__score", "__gone", "__key", "__spans", "__row_key", "__whole", "__id", "__source", "__size", "node", "ids"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    base = [(1, "the cat sat on the mat and mailed a@b.co " * 3, "en", "s", 1), (1, "the cat sat on the mat and mailed a@b.co " * 3, "en", "s", 1), (2, None, None, None, None), (None, "the dog was in the house of the cat", "en", None, None), (4, "", "en", "s", 0), (5, "w " * 60_000, None, "t", 9), (6, "der hund und die katze in dem haus " * 2, "de", "t", 9)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in base], kinds)
    want = {"language_id": [None, 1, 1, 5, 6], "near_duplicates": [None, 1, 1, 2, 5, 6], "personal_data": [None, 1, 1, 2, 4, 5, 6]}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        got = out.collect()
        ids = sorted((r["doc_id"] for r in got), key=lambda d: d or 0)
        assert out.columns == docs.columns if name != "pieces" else "text" not in out.columns
        assert all(r[n] == i for r in got for i, n in enumerate(names) if n != "ids" or name != "pieces")
        if name in want:
            assert ids == want[name], (name, ids)
        else:
            assert set(ids) == {r[0] for r in base}
    texts = {r["doc_id"]: r["text"] for r in cp.personal_data(spark, docs, SF).collect()}
    assert texts[2] is None and texts[4] == "" and texts[5] == base[5][1] and "[EMAIL]" in texts[1]


def test_dedup_keeps_a_null_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.dedup(docs).collect()} == {None, 1}
