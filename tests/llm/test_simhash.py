import numpy as np
import xxhash
from pyspark.sql import functions as F

from concord.llm import simhash

DATA = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, max_bits):
    """Component of each distinct fingerprint by brute force."""
    fps = np.array(sorted(fps), np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits):
            root[find(int(j))] = find(i)
    return {int(f): find(i) for i, f in enumerate(fps)}


def check(rows, got):
    plain = {d: plain_fingerprint(t) for d, t in rows}
    part = classes(set(plain.values()), 4)
    least = {}
    for d, f in plain.items():
        least[part[f]] = min(least.get(part[f], d), d)
    want = {d: (f, least[part[f]]) for d, f in plain.items()}
    assert {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in got} == want


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, simhash.near_duplicates(docs).collect())


def test_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base]
    for _ in range(8):  # drifting copies: chains longer than four bits
        near.append(near[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    fps = sorted({int(x) for x in np.concatenate([*near, dense])})
    table = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    edges = simhash.links(table).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 or ((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4 for r in edges)
    got = {}
    for r in simhash.components(simhash.links(table)).collect():
        got.setdefault(r["root"], set()).add(r["node"] % 2**64)
    want = {}
    for f, c in classes(fps, 4).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_edges(spark):
    long = "word " * 30000
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, " \n", "y"), (4, "A b", "z"), (5, "a  B\n", "z"), (5, "a  B\n", "z"), (None, long, "q"), (8, long, None)], "doc_id long, text string, fp string")
    got = {(r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 8), (8, 8)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "8", "None"]


def test_components_of_a_long_chain(spark):
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(10_000, 10_001), (10_001, 10_001), (None, 4)], "a long, b long")
    got = simhash.components(chain.union(more))
    assert got.count() == n + 3 and got.select("root").distinct().count() == 2


def test_resembling_texts_are_found_and_others_left(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        for c in range(4):
            copy = list(words)
            for at in rng.integers(0, 400, 5):  # at most 25 of 396 shingles change: similarity 0.88 or more
                copy[at] = f"x{rng.integers(0, 5000)}" if c else copy[at]
            rows.append((4 * g + c, " ".join(copy)))
            want[4 * g + c] = 4 * g
        far = list(words)
        for at in range(0, 400, 12):  # four in ten shingles change: similarity about 0.4
            far[at] = f"y{rng.integers(0, 5000)}"
        rows.append((1000 + g, " ".join(far)))
        want[1000 + g] = 1000 + g
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = {r["id"]: r["component_id"] for r in simhash.resembling(docs).collect()}
    assert sum(got[d] == want[d] for d in want if d < 1000) >= 235 and all(got[d] == want[d] for d in want if d >= 1000)


def test_thinned_buckets_lose_no_verified_link(spark):
    rng = np.random.default_rng(3)
    names, lanes, lane_bits, max_bits = ["f0", "f1", "f2", "f3"], 4, 13, 42

    def flipped(x, n):
        for bit in rng.choice(64, n, replace=False):
            x ^= 1 << int(bit)
        return x

    sigs = set()
    for size in (3, 8, 30, 150):  # the first lane is nearly the same in a group, the others tell pairs of it from the rest
        base = int(rng.integers(0, 2**63))
        for _ in range(size):
            rest = [int(x) for x in rng.integers(0, 2**63, 3)]
            for _ in range(2):
                sigs.add((flipped(base, 2), *[flipped(x, 5) for x in rest]))
    sigs = sorted(sigs)

    def linked(a, b):
        apart = [x ^ y for x, y in zip(a, b, strict=True)]
        near = [x.bit_count() <= lane_bits and any((x >> o & ((1 << w) - 1)).bit_count() <= 1 for o, w in simhash.SEGMENTS) for x in apart]
        return any(near) and sum(x.bit_count() for x in apart) <= max_bits

    want = {s: {s} for s in sigs}
    for i, a in enumerate(sigs):
        for b in sigs[i + 1 :]:
            if linked(a, b) and want[a] is not want[b]:
                want[a] |= want[b]
                for s in want[a]:
                    want[s] = want[a]
    table = spark.createDataFrame([tuple(int(np.uint64(x).view(np.int64)) for x in s) for s in sigs], "f0 long, f1 long, f2 long, f3 long")
    got = {s: {s} for s in sigs}
    for r in simhash.signature_links(table, names, lane_bits, max_bits).collect():
        ends = [int(x) % 2**64 for x in r]
        a, b = tuple(ends[:lanes]), tuple(ends[lanes:])
        assert linked(a, b)
        got[a] |= got[b]
        for s in got[a]:
            got[s] = got[a]
    assert sum(len(x) > 1 for x in want.values()) > 300 and got == want
