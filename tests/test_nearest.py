import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.operators import matching, nearest, retrieval


def test_nearest_compares_no_pair_of_copies(spark):
    """Rows of equal terms are scored once for all: at 20,000 copies a side, pairs of rows would be 4 * 10^8."""
    side = lambda p: spark.range(20_000).select(F.concat(F.lit(p), F.lpad("id", 5, "0")).alias("entity_id"), F.concat(F.lit("7 "), F.col("id") % 3).alias("x"))
    got = retrieval.rare_terms(side("a"), side("b"), retrieval.words(F.col("x")), 2, 0.02)
    rows = {(r["sid"], r["tid"], r["rank"]) for r in got.where("sid < 'a00006'").collect()}
    assert rows == {(f"a{i:05}", f"b{i % 3 + 3 * j:05}", j + 1) for i in range(6) for j in range(2)} and got.count() == 40_000


def test_nearest_against_all_pairs(spark, monkeypatch):
    for name, value in (("ASKING", 7), ("ASKED", 11), ("DENSE", 40), ("MEETINGS", 20)):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcdefgh", k=rng.randint(0, 5)) + rng.choices([f"r{i}" for i in range(30)], k=rng.randint(0, 2)))
    one, two = [(f"s{i:03}", text()) for i in range(60)], [(f"t{i:03}", text()) for i in range(300)]
    terms, n = {i: Counter(t.split()) for i, t in one + two}, len(two)
    df = Counter(w for i, _ in two for w in terms[i])
    want = {}
    for s, _ in one:
        known = {w for w in terms[s] if w in df}
        met = [t for t, _ in two if known and (any(df[w] <= 50 for w in known & set(terms[t])) or known == set(terms[t]))]
        scores = sorted((-round(sum(min(math.log(n / df[w]), 6.0) for w in known & set(terms[t])), 9), t) for t in met)
        want[s] = [(t, -score) for score, t in scores[:4]]
    frames = [spark.createDataFrame(rows, "entity_id string, x string") for rows in (one, two)]
    got = {s: [] for s in want}
    for r in retrieval.rare_terms(*frames, retrieval.words(F.col("x")), 4, 0.02).orderBy("sid", "rank").collect():
        got[r["sid"]].append((r["tid"], r["score"]))
    assert {s: [t for t, _ in x] for s, x in got.items()} == {s: [t for t, _ in x] for s, x in want.items()}
    assert all(a == pytest.approx(b, abs=2e-9) for s in want for (_, a), (_, b) in zip(got[s], want[s], strict=True))


def test_dense_leaves_out_what_has_no_cosine_and_keeps_ties_by_id(spark, monkeypatch):
    for name, value in (("VECTORS_ASKING", 2), ("VECTORS_ASKED", 3), ("SCORES", 4)):
        monkeypatch.setattr(nearest, name, value)
    vectors = lambda rows: spark.createDataFrame(rows, "id long, vec array<float>")
    one = vectors([(0, [1.0, 0.0]), (3, [0.0, 0.0]), (6, None), (9, [1e-30, 1e-30])])
    two = vectors([(i, [2.0, 0.0]) for i in (8, 2, 5, 7, 1)] + [(4, [3.0, 3.0]), (10, [0.0, 0.0]), (11, [1.0, None]), (13, [float("nan"), 1.0])])
    got = [tuple(r) for r in retrieval.dense(one, two, 3).orderBy("sid", "rank").collect()]
    assert got == [(0, 1, 1.0, 1), (0, 2, 1.0, 2), (0, 5, 1.0, 3), (9, 4, 1.0, 1), (9, 1, 0.707106781, 2), (9, 2, 0.707106781, 3)]


def test_matchers_compute_only_what_they_read(spark):
    """The features that a matcher reads are some of all; the others used to be computed and written with every pair."""
    from concord.plans import extensions

    pairs, first, links = extensions._scored(spark, "/root/testdata/sf0.001")
    assert set(pairs.columns) == {*extensions.USED, "label", "fold", "prob"}
    got = matching.hard_negatives(pairs).groupBy("sid").count()
    assert got.where("count > 3").isEmpty() and not got.isEmpty()


def test_retrievers_of_a_query_run_at_once_on_all_cores(spark, monkeypatch):
    """One after another none would pass the barrier; a small table used to stay in one partition in all of their stages."""
    from concord.plans import extensions

    barrier, parts = threading.Barrier(3, timeout=60), []

    def retriever(first, others):
        barrier.wait()
        parts.append((first.rdd.getNumPartitions(), others.rdd.getNumPartitions()))
        return first.select(F.col("entity_id").alias("sid"))

    monkeypatch.setattr(extensions, "RETRIEVERS", dict.fromkeys("abc", retriever))
    found, *_ = extensions._found(spark, "/root/testdata/sf0.001")
    cores = spark.sparkContext.defaultParallelism
    assert list(found) == ["a", "b", "c"] and parts == [(cores, cores)] * 3


def test_pair_features_weigh_no_words(spark, monkeypatch):
    """The query has no feature of rare words, yet it exploded and joined the words of every pair."""
    from concord.plans import extensions

    monkeypatch.setattr(extensions.retrieval, "frequencies", lambda *_: pytest.fail("frequencies of words that no column needs"))
    plan = extensions.er_pair_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("name_words1") and plan.count("split(") <= 4


def test_terms_are_made_once_a_text(spark):
    """Terms and their digest used to be made for each record, and twice, however many records have the same text."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(x):
        calls.add(1)
        return x and x.split()

    side = lambda p: spark.range(2000).select(F.concat(F.lit(p), F.lpad("id", 4, "0")).alias("entity_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("7 "), F.col("id") % 4)).alias("x"))
    got = retrieval.rare_terms(side("a"), side("b"), split(F.col("x")), 1, 0.02).collect()
    assert {(r["sid"], r["tid"]) for r in got} == {(f"a{i:04}", f"b{i % 4:04}") for i in range(2000) if i % 4} and calls.value < 200
