import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from concord.llm import mixing

DATA = "/root/testdata/sf0.01"


def weights(tokens, x):
    power = {s: (n / sum(tokens.values())) ** x if n else 0.0 for s, n in tokens.items()}
    return {s: p / (sum(power.values()) or 1) for s, p in power.items()}


def plain(rows, hashes, max_repeats, entropy=None):
    """Copies of each row, by loops: rows (id, source, n), hashes (id, epoch) -> place."""
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    live = {s: n for s, n in tokens.items() if n}

    def reached(x):
        w = weights(live, x)
        if entropy is not None:
            return -sum(p * math.log2(p) for p in w.values()) >= entropy
        e = [w[s] / n for s, n in live.items()]
        return max(e) / min(e) > max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if reached(1.0):
        x = 1.0
    elif not reached(0.0):
        x = 0.0
    else:
        for _ in range(48):
            mid = (low + high) / 2
            low, high = (mid, high) if reached(mid) else (low, mid)
        x = low if entropy is not None else high
    w = weights(live, x)
    budget = max(n / w[s] for s, n in live.items())
    copies = []
    whole, last = {}, {}
    for s in tokens:
        if s not in live:
            whole[s], last[s] = 1, -1
            continue
        b = w[s] * budget * (1 + 1e-12)
        whole[s] = math.floor(b / tokens[s])
        rest, at, last[s] = b - whole[s] * tokens[s], 0, -1
        grouped = defaultdict(int)
        for i, t, n in rows:
            if t == s:
                grouped[hashes[i, whole[s]]] += n
        for h in sorted(grouped):
            at += grouped[h]
            if at > rest:
                break
            last[s] = h
    for i, s, _ in rows:
        copies.append((i, s, whole[s] + (last[s] >= 0 and hashes[i, whole[s]] <= last[s])))
    return copies


def compare(spark, docs, **options):
    marked = docs.select("doc_id", "source", mixing.tokens_of(F.col("text")).alias("n"), *[mixing._hash(F.col("doc_id"), F.lit(e), 42).alias(f"h{e}") for e in range(4)]).collect()
    hashes = {(r["doc_id"], e): r[f"h{e}"] for r in marked for e in range(4)}
    want = Counter()
    for i, s, c in plain([(r["doc_id"], r["source"], r["n"]) for r in marked], hashes, **options):
        want[i, s] += c
    lines = mixing.plan(docs, max_repeats=options["max_repeats"], target_entropy=options.get("entropy"))
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs, lines).collect())
    assert got == want
    return lines, want


def test_whole_table_by_repetition_limit(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lines, copies = compare(spark, docs, max_repeats=1.5)
    assert min(copies.values()) == 1 and max(copies.values()) == 2
    assert abs(lines.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    most = lines.agg(F.max("epochs"), F.min("epochs")).first()
    assert abs(most[0] - 1.5) < 1e-6 and abs(most[1] - 1) < 1e-6


def test_target_entropy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lines, _ = compare(spark, docs, max_repeats=2.0, entropy=4.315)
    entropy = -sum(r["weight"] * math.log2(r["weight"]) for r in lines.collect())
    assert entropy == pytest.approx(4.315, abs=1e-6)


def test_a_budget_keeps_the_repetition_limit(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokens = mixing.plan(docs).agg(F.sum("tokens")).first()[0]
    for passes in (0.3, 1.0, 1.7):
        lines = mixing.plan(docs, max_repeats=2.0, budget=passes * tokens).collect()
        assert sum(r["budget"] for r in lines) == pytest.approx(passes * tokens)
        assert max(r["epochs"] for r in lines) <= 2.0 * (1 + 1e-6)
    with pytest.raises(ValueError):
        mixing.plan(docs, max_repeats=2.0, budget=2.1 * tokens)


def test_the_mixture_interleaves_sources(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mixing.mix(docs.select("doc_id", "source"), mixing.plan(docs))
    half = mixed.where("source = 'src0'").agg(F.avg((F.col("mix_key") < 0.5).cast("int"))).first()[0]
    assert 0.35 < half < 0.65


def test_edges(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (None, "d e", None, 1), (3, None, "empty", 1), (4, "", "empty", 1), (5, "w " * 30_000, "big", 1), (6, "q", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key int")
    _, copies = compare(spark, docs, max_repeats=2.0)
    assert all(copies[r[0], r[2]] >= 1 for r in rows)
    empty = docs.limit(0)
    assert mixing.mix(empty, mixing.plan(empty)).count() == 0
    clash = docs.withColumnsRenamed({"mix_key": "__last"}).withColumn("__whole", F.lit(7))
    assert Counter(tuple(r)[:5] for r in mixing.mix(clash, mixing.plan(clash)).collect()) == Counter({(*r, 7): copies[r[0], r[2]] * rows.count(r) // sum(x[0] == r[0] and x[2] == r[2] for x in rows) for r in rows})
    assert mixing.mix(docs, mixing.plan(docs)).columns == ["doc_id", "text", "source", "mix_epoch", "mix_key"]
