from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from concord.llm import components, minhash, simhash

DATA = "/root/testdata/sf0.01"


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(rows):
    """Smallest id of each row's component, from the Jaccard similarity of all pairs that share a shingle."""
    sets, root, holders, both = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, defaultdict(list), Counter()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for x in s or {None}:
            holders[x].append(d)
    for ids in holders.values():
        both.update(combinations(sorted(ids), 2))
    for (a, b), n in both.items():
        if n * 9 >= 4 * (len(sets[a]) + len(sets[b])) or not sets[a] | sets[b]:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in root}


def told(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    return {r["id"]: r["component_id"] for r in simhash.resembling(docs).collect()}


def pair(rng, n, similarity):
    """Two texts of n five-word shingles, of about that Jaccard similarity and not less: the ends differ."""
    own = int((1 - similarity) * n / (1 + similarity))
    shared = [f"s{x}" for x in rng.integers(0, 10**9, n - own + 4)]
    return [" ".join(shared + [f"{w}{x}" for x in rng.integers(0, 10**9, own)]) for w in "ab"]


def test_every_pair_at_the_threshold_is_found(spark):
    rng, rows = np.random.default_rng(7), []
    for g in range(400):
        for c, text in enumerate(pair(rng, 90 + g, 0.8 + 0.05 * (g % 2))):
            rows.append((2 * g + c, text))
    got = told(spark, rows)
    assert got == plain_groups(rows) and all(got[d] == d - d % 2 for d, _ in rows)


def test_every_group_of_a_table_is_that_of_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["id"]: r["component_id"] for r in simhash.resembling(docs).collect()} == plain_groups(rows)


def test_a_large_group_of_drifting_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for d in range(300):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 12)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(words)))
    want = plain_groups(rows)
    assert 20 < len(set(want.values())) < 290 and told(spark, rows) == want


def test_texts_below_the_threshold_and_with_repeated_lines_are_left(spark):
    rng, rows = np.random.default_rng(13), []
    for g in range(150):
        line = " ".join(f"l{x}" for x in rng.integers(0, 10**9, 14))
        if g % 3:
            texts = pair(rng, 90 + g, 0.79 - 0.05 * (g % 3))
        else:
            texts = ["\n".join([" ".join(f"o{x}" for x in rng.integers(0, 10**9, 100)), *[line] * 15]) for _ in range(2)]
        rows += [(2 * g + c, t) for c, t in enumerate(texts)]
    got = told(spark, rows)
    assert got == plain_groups(rows) == {d: d for d, _ in rows}


def test_a_repeated_id_loses_only_its_copied_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.dedup(docs).collect()) == [(1, "a b c d e f"), (5, "u v w x y z")]


def test_texts_within_four_bits_meet_by_their_fingerprints(spark, monkeypatch):
    """Without any band: the stage's links used to come from bands alone."""
    rng, rows = np.random.default_rng(17), []
    for g in range(80):
        text = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 150 + g))
        rows += [(3 * g, text), (3 * g + 1, f"{text} more"), (3 * g + 2, " ".join(pair(rng, 90 + g, 0.8)))]
    prints = {d: simhash.fingerprint(t.encode(), 5) for d, t in rows}
    within = {g for g in range(80) if (prints[3 * g] ^ prints[3 * g + 1]).bit_count() <= 4}
    assert len(within) > 60
    of = minhash.nodes_of
    monkeypatch.setattr(minhash, "nodes_of", lambda *a: of(*a).withColumn("bands", F.array().cast("array<long>")))
    assert told(spark, rows) == {d: d - 1 if d % 3 == 1 and d // 3 in within else d for d, _ in rows}


def test_equal_and_linked_fingerprints_make_candidates_not_links(spark):
    nodes = spark.createDataFrame([(5, 9), (2, 9), (7, 9), (4, 8), (3, 1 << 40)], "node long, fp long")
    assert sorted(tuple(r) for r in simhash.close(nodes).collect()) == [(2, 3), (2, 4), (2, 5), (2, 7), (3, 4)]
    rows = [(1, "a b c d e f"), (2, "a b c d e g")]  # two shingles each, one shared: 1 in 3
    assert told(spark, rows) == {1: 1, 2: 2}


def test_a_fingerprint_near_zero_does_not_meet_texts_without_a_word(spark):
    texts = (" ".join(f"{n}x{i}" for i in range(6)) for n in range(10**6))
    text = next(t for t in texts if simhash.fingerprint(t.encode(), 5).bit_count() <= 4)
    assert told(spark, [(1, None), (2, text), (3, " "), (4, f"{text} ")]) == {1: 1, 2: 2, 3: 1, 4: 2}


def test_candidates_are_those_of_fingerprints_alone(spark):
    """By brute force over the rule; the stage's candidates used to be MinHash's, and its fingerprints left repeats out."""
    rng, texts = np.random.default_rng(23), []
    for g in range(40):
        texts += pair(rng, 60 + g, 0.8)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 200)]
    texts += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(12)]
    texts += ["\n".join(["a line that is there again and again"] * 9 + texts[0].split()), "a b c d e f g"]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string")
    nodes = minhash.nodes_of(docs, "doc_id", "text", 5, 0.8).localCheckpoint()
    own = {r["id"]: r for r in nodes.collect()}
    assert all(own[d]["fp"] % 2**64 == simhash.fingerprint(t.encode(), 5) for d, t in enumerate(texts))
    assert own[len(texts) - 1]["bands"] == []  # three shingles: no other set is at 0.8

    def meets(x, y):
        bits = [(a ^ b) % 2**64 for a, b in zip(x, y, strict=True)]
        return any(
            any((b >> o & ((1 << w) - 1)).bit_count() <= 1 for o, w in simhash.SEGMENTS) and b.bit_count() <= 16 and b.bit_count() + c.bit_count() <= 24
            for b, c in zip(bits, bits[1:] + bits[:1], strict=True)
        )

    told_apart = {r["node"]: r["bands"] for r in own.values() if r["bands"]}
    want = {(a, b) for a, b in combinations(sorted(told_apart), 2) if meets(told_apart[a], told_apart[b])}
    got = {}
    for r in simhash.meeting(nodes.select("node", "bands")).collect():
        got[r["a"], r["b"]] = got.get((r["a"], r["b"]), False) or r["thinned"]
    root = {n: n for n in told_apart}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for (a, b), thinned in got.items():
        if thinned:
            root[find(a)] = find(b)
    assert any(got.values()) and set(got) <= want and all(p in got or find(p[0]) == find(p[1]) for p in want)
    assert all(tuple(sorted((own[d]["node"], own[d + 1]["node"]))) in got for d in range(0, 80, 2))


def test_a_group_of_near_copies_is_compared_along_few_pairs(spark, monkeypatch):
    """By what was linked before and one forest a half; each variant used to have a forest of its own, whatever was linked."""
    rng = np.random.default_rng(29)
    base, rows = [f"w{x}" for x in rng.integers(0, 10**9, 150)], []
    for d in range(400):
        words = list(base)
        for at in rng.integers(0, 150, 2):
            words[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((d, " ".join(words)))
    compared, of = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda *a: compared.append(a[-1].where("not known").count()) or of(*a))
    assert told(spark, rows) == plain_groups(rows) == {d: 0 for d, _ in rows}
    assert compared[0] < 400 * 20 and compared[1] < 400, compared


def test_nodes_of_one_part_do_not_meet_again(spark):
    rng, texts = np.random.default_rng(31), []
    for g in range(30):
        texts += pair(rng, 80 + g, 0.85)
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string")
    nodes = minhash.nodes_of(docs, "doc_id", "text", 5, 0.8).localCheckpoint()
    assert simhash.meeting(nodes.select("node", "bands")).where("not known").count() >= 30
    parted = nodes.select("node", "bands", F.floor(F.col("id") / 2).alias("part"))
    assert simhash.meeting(parted).where("not known").count() == 0


def test_components_of_a_chain_keep_their_estimates_small(spark, monkeypatch):
    """The planner multiplies sizes at each join; they were kept from round to round until their digits took minutes."""
    bits, of = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()) or of(df))
    edges = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = components.components(edges)
    assert found.count() == 301 and found.select("root").distinct().count() == 1
    assert len(bits) > 12 and max(bits) < 6000, max(bits)
