import math
from collections import Counter

import pytest

from concord.llm import backoff


def plain(rows, min_count=2):
    split = [[w for w in (t or "").replace("\n", " ").split(" ") if w] for _, t in rows]
    c1 = Counter(w for ws in split for w in ws)
    c2 = Counter(p for ws in split for p in zip(ws, ws[1:], strict=False))
    total, out = sum(c1.values()), {}
    for (d, _), ws in zip(rows, split, strict=True):
        n, s = out.get(d, (0, 0.0))
        for v, w in zip(ws, ws[1:], strict=False):
            s += math.log(c2[v, w] / c1[v]) if c2[v, w] >= min_count else math.log(0.4 * c1[w] / total)
            n += 1
        out[d] = (n, s)
    return out


@pytest.mark.parametrize(("min_share", "slices"), [(1e-6, 1), (0.01, 2), (0.9, 3)])
def test_against_loops(spark, min_share, slices):
    rows = [(i, " ".join(f"w{(i * j * j) % (7 + i % 5 * 20)}" for j in range(i))) for i in range(120)]
    rows += [(1, None), (2, ""), (3, "solo"), (3, "solo two solo two"), (None, "w1 w2"), (-(2**63), "w2 w3 w4"), (200, "of the " * 30_000), (201, "é\nü é ü")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    # small chunks and partitions, so that their edges are crossed
    scored = backoff.score(docs, min_share=min_share, slices=slices, chunk=500, rows=10_000)
    got = {r["id"]: (r["n_scored"], r["log_score"]) for r in scored.collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d][0] == n and abs(got[d][1] - s) < 1e-6 * max(1, abs(s))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert backoff.score(docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "word")], "doc_id long, text string")
    assert sorted(map(tuple, backoff.score(nothing).collect())) == [(1, 0, 0.0), (2, 0, 0.0)]
