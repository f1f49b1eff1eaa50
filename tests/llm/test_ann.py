import math

import numpy as np
import pyarrow as pa

from concord.llm import ann

DATA = "/root/testdata/sf0.1"


def exact(ids, x, asked, k):
    out = {}
    for q in asked:
        s = (x * x[ids.index(q)]).sum(axis=1)
        best = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [(i, -v) for v, i in best]
    return out


def test_recall_and_scores_on_the_whole_table(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.collect())
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    model = ann.fit(vectors)
    index = ann.encode(vectors, model)
    assert index.count() == len(rows)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in ann.search(index, index.where("id % 20 = 0").select("id", "vec"), model).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.95
    by = dict(zip(ids, x, strict=True))
    assert all(abs(s - (by[q] * by[i]).sum()) < 1e-12 for q, v in got.items() for i, s in v)


def test_blocks_do_not_depend_on_batches():
    table = pa.table({"id": np.arange(10_000)})
    cut = lambda n: [b.column(0).to_pylist() for b in ann._blocks(iter(table.to_batches(max_chunksize=n)))]
    assert cut(10_000) == cut(512) == cut(4096) == cut(7) and [len(x) for x in cut(512)] == [4096, 4096, 1808]


def test_anisotropic_codes_lose_less_in_parallel():
    rng = np.random.default_rng(1)
    x, books = rng.normal(size=(500, 8)), rng.normal(size=(4, 16, 2))
    loss = {}
    for eta in (1.0, 6.0):
        codes = ann.assign(x, books, eta)
        r = x - np.concatenate([books[s][codes[:, s]] for s in range(4)], axis=1)
        loss[eta] = ((r * x / np.linalg.norm(x, axis=1)[:, None]).sum(axis=1) ** 2).mean(), (r**2).sum(axis=1).mean()
    assert loss[6.0][0] < loss[1.0][0] and loss[6.0][1] >= loss[1.0][1]


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(i, [float(i % 7), 1.0, -0.5], 1) for i in range(0, 60)] + [(60, None, 1), (61, [0.0] * 3, 1), (62, [1.0, nan, 0.0], 1), (63, [1.0, inf, 0.0], 1), (64, [1.0, None, 2.0], 1), (65, [1.0], 1), (None, [1.0] * 3, 1), (5, [5.0, 1.0, -0.5], 1), (40, [5.0, 1.0, -0.5], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, codes int")
    model = ann.fit(vectors)
    index = ann.encode(vectors, model)
    got = ann.search(index, index.where("id % 20 = 0").select("id", "vec"), model, k=20).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40} and len(got) == 60
    top = [r["vec_id"] for r in got if r["query_id"] == 20]
    assert top[:8] == [6, 13, 27, 34, 41, 48, 55, 5] and top[8] == 5  # equal vectors by id; 20 itself is left out
    empty = vectors.limit(0)
    none = ann.fit(empty)
    assert ann.search(ann.encode(empty, none), empty.selectExpr("vec_id id", "cast(embedding as array<double>) vec"), none).count() == 0
