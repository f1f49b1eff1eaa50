"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into subspaces of two components, each quantised to one of 16 centres: four bits, two subspaces a byte.
For a vector x with residual r the loss is |r|^2 + (eta - 1) <r, x / |x|>^2: the part of the residual that is parallel to x
changes the inner products that matter most, and weighs eta times as much. Codes minimise it by coordinate descent over the
subspaces, centres by the least-squares system of all subspaces together. A search adds up table entries (one look-up a
byte, for blocks of queries) over all codes and scores the best of each block exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WIDTH, CENTRES = 2, 16
SWEEPS = 3
SCAN = 4096  # vectors scanned at a time
ASK = 128  # queries scanned at a time
QUERIES = 32_768  # queries broadcast at a time


@dataclass
class Quantiser:
    dim: int
    books: np.ndarray  # subspace, centre, component
    eta: float


def valid(vec: Column, dim: int) -> Column:
    """Not null, of the given length, all components finite, one of them not zero."""
    finite = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _padded(x: np.ndarray) -> np.ndarray:
    """Components up to an even number of subspaces."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * WIDTH))))


def assign(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codes (rows, subspaces) of the least anisotropic loss found by sweeps over the subspaces."""
    x = _padded(np.asarray(x, np.float64))
    n, parts = len(x), len(books)
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    codes = np.zeros((n, parts), np.int64)
    along = np.zeros((n, parts))  # each subspace's share of <r, x / |x|>
    rows = np.arange(n)
    plain, tilted = [], []
    for s in range(parts):
        cut = slice(s * WIDTH, (s + 1) * WIDTH)
        plain.append(((x[:, None, cut] - books[s]) ** 2).sum(axis=2))
        tilted.append((unit[:, cut] * x[:, cut]).sum(axis=1)[:, None] - unit[:, cut] @ books[s].T)
        codes[:, s] = plain[s].argmin(axis=1)
        along[:, s] = tilted[s][rows, codes[:, s]]
    total = along.sum(axis=1)
    for _ in range(SWEEPS if eta > 1 else 0):
        for s in range(parts):
            rest = total - along[:, s]
            codes[:, s] = (plain[s] + (eta - 1) * (rest[:, None] + tilted[s]) ** 2).argmin(axis=1)
            along[:, s] = tilted[s][rows, codes[:, s]]
            total = rest + along[:, s]
    return codes


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8000, threshold: float = 0.2, rounds: int = 6) -> Quantiser:
    """Learns the centres on the sample rows of smallest id hash (a bounded sample; the index holds every row).

    threshold is the cosine from which inner products matter; eta follows from it and the dimension, which is the one most
    rows have. No valid vector: a quantiser of dimension 0, under which no search finds anything.
    """
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    drawn = vectors.where(valid(F.col(vec_col), dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).orderBy(F.xxhash64("id"), "vec").limit(sample).select("vec").toPandas()
    if not len(drawn):
        return Quantiser(0, np.zeros((0, CENTRES, WIDTH)), 1.0)
    x = _padded(np.array(drawn["vec"].tolist(), np.float64))
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    parts, rng = x.shape[1] // WIDTH, np.random.default_rng(0)
    books = np.stack([x[rng.permutation(len(x))[np.arange(CENTRES) % len(x)], s * WIDTH : (s + 1) * WIDTH] for s in range(parts)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    size = parts * CENTRES * WIDTH
    for turn in range(rounds * 2):
        weight = 1.0 if turn < rounds else eta  # plain rounds first
        codes = assign(x, books, weight)
        place = ((np.arange(parts) * CENTRES + codes)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(len(x), -1)
        flat, old = np.zeros((size, size)), books.ravel()
        right = np.bincount(place.ravel(), x.ravel(), size)
        flat[np.arange(size), np.arange(size)] = np.bincount(place.ravel(), minlength=size)
        if weight > 1:
            z = np.zeros((len(x), size))
            z[np.arange(len(x))[:, None], place] = unit
            flat += (weight - 1) * (z.T @ z)
            right += (weight - 1) * (z.T @ np.linalg.norm(x, axis=1))
        ridge = 1e-3  # centres without a vector stay where they are
        books = np.linalg.solve(flat + ridge * np.eye(size), right + ridge * old).reshape(books.shape)
    return Quantiser(dim, books, eta)


def encode(vectors: DataFrame, model: Quantiser, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec, codes): every valid row, with its packed four-bit codes. Rows with a null id take no part."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN):
                part = batch.slice(at, SCAN)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.dim)
                codes = assign(x, m.books, m.eta)
                packed = (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "vec", "codes"])

    good = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vec_col), model.dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return good.mapInArrow(run, "id long, vec array<double>, codes binary")


def _tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Query, byte, value of the byte: the sum of both subspaces' products with their centres."""
    q = _padded(queries).reshape(len(queries), -1, WIDTH)
    single = np.einsum("qsw,scw->qsc", q, books).astype(np.float32)
    return (single[:, 1::2, :, None] + single[:, ::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(index: DataFrame, queries: DataFrame, model: Quantiser, k: int = 20, rerank: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query but its own id.

    index as from encode(); queries (id, vec). Of every block of rows a task scans, the rerank best by the tables (ties to
    the smaller id) are scored in double precision on the original vectors; a task keeps k for each query. Queries are
    broadcast some QUERIES at a time, however many there are. Repeated query ids ask once, with their least vector.
    """
    spark = index.sparkSession
    asked = durable(queries.groupBy(F.col("id").alias("id")).agg(F.min("vec").alias("vec")))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toPandas()
        shared = spark.sparkContext.broadcast((mine["id"].to_numpy(np.int64), np.array(mine["vec"].tolist(), np.float64).reshape(len(mine), model.dim), model.books))
        part = index.mapInArrow(_scan(shared, k, rerank), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows SCAN at a time, however they come, so that no result depends on the size of Arrow batches."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, SCAN - n))
            n, at = n + held[-1].num_rows, at + held[-1].num_rows
            if n == SCAN:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scan(shared, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, books = shared.value
        if not len(ids):
            return

        held_id, held_score = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)
        for part in _blocks(batches):
            rows = part.column(0).to_numpy()
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[order]
            codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(rows), -1)[order]
            for first in range(0, len(ids), ASK):
                group = slice(first, first + ASK)
                tables = _tables(asked[group], books)
                near = np.zeros((len(tables), len(rows)), np.float32)
                for byte in range(codes.shape[1]):
                    near += tables[:, byte].take(codes[:, byte], axis=1)
                cut = np.partition(near, -rerank, axis=1)[:, -rerank] if len(rows) > rerank else np.full(len(near), -np.inf)
                for i in range(len(tables)):
                    q = first + i
                    hit = np.flatnonzero(near[i] >= cut[i])
                    hit = hit[np.argsort(-near[i, hit], kind="stable")[: rerank + 1]]
                    hit = hit[rows[hit] != ids[q]]
                    exact = (vectors[hit] * asked[q]).sum(axis=1)
                    all_id, all_score = np.concatenate([held_id[q], rows[hit]]), np.concatenate([held_score[q], exact])
                    best = _best(all_id, all_score, k)
                    held_id[q], held_score[q] = all_id[best], all_score[best]
        sizes = np.fromiter(map(len, held_id), np.int64, len(ids))
        if sizes.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(held_id)), pa.array(np.concatenate(held_score))], ["query_id", "vec_id", "score"])

    return run


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi")
    return hit.count() / max(1, truth.count())
