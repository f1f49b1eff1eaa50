"""The best partners of vectors: every candidate pair of a cell of two blocks is scored in NumPy, and the best are kept.

A cell is a block of asking vectors and one of those asked. Blocks are bounded, so a cell fits a worker; no pair leaves it but
those that can be among the best. Sparse vectors are candidates if they share a rare term, or have the same terms; dense ones
all are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASKING, ASKED = 40_000, 120_000  # vectors of a block
CELLS = 24  # at least, if there are vectors enough
DENSE = 1 << 23  # numbers of a dense table of frequent terms
MEETINGS = 1 << 20  # shared rare terms looked at in one go
_SCHEMA = "a long, b long, head string, score double"


class _Block:
    """Vectors as flat arrays; frequent terms are negative."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.cls = np.concatenate([r.column("cls").to_numpy() for r in rows])
        self.head = pa.chunked_array([r.column("head") for r in rows])
        length = np.concatenate([r.column("terms").value_lengths().to_numpy() for r in rows]).astype(np.int64)
        self.terms = np.concatenate([r.column("terms").flatten().to_numpy() for r in rows])
        self.row = np.repeat(np.arange(len(self.cls)), length)
        norm = np.concatenate([r.column("norm").to_numpy() for r in rows])
        self.w = np.concatenate([r.column("w").flatten().to_numpy() for r in rows]) / norm[self.row]
        self.start = np.concatenate([[0], np.cumsum(length)])

    def dense(self, low: int, high: int, often: np.ndarray) -> np.ndarray:
        """Weights of the frequent terms of rows low to high."""
        s = slice(self.start[low], self.start[high])
        t, row, w = self.terms[s], self.row[s] - low, self.w[s]
        at = np.searchsorted(often, t) if len(often) else np.zeros(len(t), np.int64)
        ok = (t < 0) & (at < len(often))
        ok[ok] = often[at[ok]] == t[ok]
        out = np.zeros((high - low, len(often)))
        out[row[ok], at[ok]] = w[ok]
        return out

    def frequent_only(self) -> dict[bytes, list[int]]:
        """Rows without a rare term, by their terms."""
        some = np.unique(self.row[self.terms >= 0])
        out: dict[bytes, list[int]] = {}
        for r in np.setdiff1d(np.arange(len(self.cls)), some).tolist():
            out.setdefault(np.sort(self.terms[self.start[r] : self.start[r + 1]]).tobytes(), []).append(r)
        return out


def _best(q: np.ndarray, idx: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q, which is sorted; ties go to the smaller idx."""
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    size = np.diff(np.concatenate([first, [len(q)]]))
    keep = np.ones(len(q), bool)
    for s, n in zip(first[size > k].tolist(), size[size > k].tolist(), strict=True):
        part = score[s : s + n]
        keep[s : s + n] = part >= np.partition(part, n - k)[n - k]
    at = np.flatnonzero(keep)
    at = at[np.lexsort((idx[at], -score[at], q[at]))]
    first = np.flatnonzero(np.concatenate([[True], q[at][1:] != q[at][:-1]]))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
    return at[place < k]


def _cell(one: _Block, two: _Block, k: int) -> Iterator[pa.RecordBatch]:
    often = np.unique(two.terms[two.terms < 0])
    same, wanted = two.frequent_only(), one.frequent_only()
    alike = sorted((x, y) for key, rows in wanted.items() for x in rows for y in same.get(key, []))
    alike_q, alike_y = (np.array(c, np.int64) for c in (zip(*alike, strict=True) if alike else ((), ())))
    step = max(1, min(len(two.cls), DENSE // max(1, len(often))))
    rare = np.flatnonzero(one.terms >= 0)
    for low in range(0, len(two.cls), step):
        high = min(low + step, len(two.cls))
        table = two.dense(low, high, often)
        s = slice(two.start[low], two.start[high])
        posted = np.flatnonzero(two.terms[s] >= 0) + two.start[low]
        posted = posted[np.argsort(two.terms[posted], kind="stable")]
        term, begin, count = np.unique(two.terms[posted], return_index=True, return_counts=True)
        row, weight = two.row[posted] - low, two.w[posted]
        at = np.searchsorted(term, one.terms[rare])
        hit = at < len(term)
        hit[hit] = term[at[hit]] == one.terms[rare][hit]
        ask, at = rare[hit], at[hit]
        begin, count = begin[at], count[at]
        meets = np.bincount(one.row[ask], weights=count, minlength=len(one.cls)) + 1
        done = np.cumsum(meets)
        x = 0
        while x < len(one.cls):
            y = max(x + 1, min(int(np.searchsorted(done, (done[x - 1] if x else 0) + MEETINGS)), x + max(1, DENSE // max(1, len(often)))))
            a, b = np.searchsorted(one.row[ask], (x, y))
            n = count[a:b]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(begin[a:b], n) + inside
            key = (np.repeat(one.row[ask[a:b]], n) - x) * (high - low) + row[p]
            s = np.repeat(one.w[ask[a:b]], n) * weight[p]
            more = (alike_q >= x) & (alike_q < y) & (alike_y >= low) & (alike_y < high)
            key = np.concatenate([key, (alike_q[more] - x) * (high - low) + alike_y[more] - low])
            s = np.concatenate([s, np.zeros(more.sum())])
            if len(key):
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                score, key = np.add.reduceat(s[order], first), key[first]
                q, idx = key // (high - low), key % (high - low)
                if len(often):
                    own = one.dense(x, y, often)
                    part = max(1, DENSE // len(often) // 4)
                    for i in range(0, len(q), part):
                        score[i : i + part] += np.einsum("ij,ij->i", own[q[i : i + part]], table[idx[i : i + part]])
                score = np.round(score, 9)
                top = _best(q, idx, score, k)
                yield pa.RecordBatch.from_arrays([pa.array(one.cls[q[top] + x]), pa.array(two.cls[idx[top] + low]), two.head.take(pa.array(idx[top] + low)).combine_chunks(), pa.array(score[top])], ["a", "b", "head", "score"])
            x = y


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[pa.RecordBatch]]]:
    """The asking and the asked rows (sides 1 and 0) of each cell that has both; rows come sorted by cell and side."""
    held: tuple[list[pa.RecordBatch], list[pa.RecordBatch]] = ([], [])
    last = None
    for batch in batches:
        key = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            cell, side = divmod(int(key[a]), 2)
            if cell != last:
                if held[0] and held[1]:
                    yield held[1], held[0]
                held, last = ([], []), cell
            held[side].append(batch.slice(a, b - a))
    if held[0] and held[1]:
        yield held[1], held[0]


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for one, two in _by_cell(batches):
        yield from _cell(_Block(one), _Block(two), k)


def best(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """(a, b, head, score): for each class of one its k best of two, of every block of two; head is that of b.

    Both have (cls, head, terms, w, norm): longs, negative for frequent terms, and their weights, to be divided by norm.
    Scores are sums of products, rounded to nine digits; ties go to the smaller head.
    """
    n1, n2 = one.count(), two.count()
    right = max(1, -(-n2 // ASKED))
    left = max(1, -(-n1 // ASKING), min(-(-CELLS // right), -(-n1 // 500)))
    block = lambda n: F.pmod(F.xxhash64("cls"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    asked = two.select("*", every(left)).withColumn("cell", F.col("other") * right + block(right)).withColumn("side", F.lit(0))
    asking = one.select("*", every(right)).withColumn("cell", block(left) * right + F.col("other")).withColumn("side", F.lit(1))
    columns = [F.col("cell").cast("long").alias("cell"), "side", "cls", "head", "terms", "w", "norm"]
    met = asked.select(columns).unionByName(asking.select(columns)).repartition(left * right, "cell").sortWithinPartitions("cell", "side", "head")
    return met.mapInArrow(lambda batches: _cells(batches, k), _SCHEMA)


VECTORS_ASKING, VECTORS_ASKED = 4_000, 20_000  # dense vectors of a block
SCORES = 1 << 22  # cosines looked at in one go


def _unit(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    vec = np.concatenate([r.column("vec").flatten().to_numpy() for r in rows])
    ids = np.concatenate([r.column("id").to_numpy() for r in rows])
    vec = vec.reshape(len(ids), -1)
    return ids, vec / np.abs(vec).max(axis=1)[:, None]  # neither overflows nor vanishes when squared


def _dense_cell(one: list[pa.RecordBatch], two: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    (ask, x), (ids, y) = _unit(one), _unit(two)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    step = max(1, SCORES // len(ids))
    for at in range(0, len(ask), step):
        score = np.round(x[at : at + step] @ y.T / np.sqrt(xx[at : at + step, None] * yy), 9)
        if len(ids) > k:
            q, idx = np.nonzero(score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None])
        else:
            q, idx = np.indices(score.shape).reshape(2, -1)
        top = _best(q, idx, score[q, idx], k)
        yield pa.RecordBatch.from_arrays([pa.array(ask[at + q[top]]), pa.array(ids[idx[top]]), pa.array(score[q[top], idx[top]])], ["sid", "tid", "score"])


def _dense_cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for one, two in _by_cell(batches):
        yield from _dense_cell(one, two, k)


def dense(first: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(sid, tid, score): for each sid its k best tids by cosine, of every block of others.

    Both have (id, vec): longs and arrays of numbers, all of one length. Vectors that are null, zero, or hold a null or a
    number that isn't finite have no cosine and take no part. Scores are rounded to nine digits; ties go to the smaller tid.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = lambda df: df.select("id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda v: v != 0))
    one, two = usable(first), usable(others)
    n1, n2 = one.count(), two.count()
    right = max(1, -(-n2 // VECTORS_ASKED))
    left = max(1, -(-n1 // VECTORS_ASKING), min(-(-CELLS // right), -(-n1 // 500)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    asked = two.select("*", every(left)).select((F.col("other") * right + block(right)).cast("long").alias("cell"), F.lit(0).alias("side"), "id", "vec")
    asking = one.select("*", every(right)).select((block(left) * right + F.col("other")).cast("long").alias("cell"), F.lit(1).alias("side"), "id", "vec")
    met = asked.unionByName(asking).repartition(left * right, "cell").sortWithinPartitions("cell", "side", "id")
    return met.mapInArrow(lambda batches: _dense_cells(batches, k), "sid long, tid long, score double")
