"""Texts of a given Jaccard similarity of their shingle sets: fingerprints find candidates, the sets decide.

A text is its set of distinct shingles (64-bit hashes). Candidates come by one-wildcard variants of fingerprints (see
simhash): of the text's own one, over all its shingles, at four bits or fewer; and of BANDS more, each over other hashes of
the set, as four bits mean near equality. At Jaccard 0.8 a bit of those differs with probability 0.152, two texts meet in one
band with 0.36, and miss each other in all with 3e-6 (2e-5 for the least favourable sizes of sets, under 15). There is no
MinHash here any more; the module's name is that of its tests. Whoever meets is compared by its whole set, and only pairs at
or over the threshold are links. Texts of equal sets are one node, so copies are never paired. What moves to be compared are
the texts, which are smaller than their sets.

Large buckets are not expanded into pairs but to a forest of their candidates. What such forests connect and the links don't
is settled among the sets themselves: they are brought together, and each is compared with all that it is not connected to.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, shuffles_dropped, sized, small_batches
from .components import components

BANDS = 28
SLICE = 255  # members whose bits are counted at a time, in bytes
_DRAWN = np.random.default_rng(20).integers(0, 2**64, (2, BANDS), dtype=np.uint64)
HELD = 64  # sets kept by a task that verifies pairs
FLIP, TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
COMMON = np.uint64(0x5851F42D4C957F2D)  # a member that all sets are given, so that small ones differ in fewer bits


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = list(simhash._hashes(data, shingle, 42))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands_of(members: np.ndarray) -> np.ndarray:
    """BANDS fingerprints of a set: a bit is set if it is set in over half of its members' hashes."""
    members, total = np.append(members, COMMON), np.zeros(64 * BANDS, np.int64)
    for at in range(0, len(members), SLICE):
        x = (members[at : at + SLICE, None] ^ FLIP) * TIMES
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(members), bitorder="little").view(np.uint64)


def node_of(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes())


WORDLESS = int(np.uint64(node_of(np.zeros(0, np.uint64))).view(np.int64))  # the node of all texts without a word


def row_key(text: Column) -> Column:
    """A text's own hash; with the id it tells rows apart."""
    return F.xxhash64(text.cast("binary"))


def _alike(both: np.ndarray, sizes: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether the intersection is large enough for the sum of both sizes, in whole numbers."""
    p, q = least.numerator, least.denominator
    return both * (p + q) >= p * sizes


def forest(sets: list[np.ndarray], part: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect, given parts that are connected already."""
    length = np.array([len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    part, found = part.copy(), []
    for x in np.flatnonzero(part != np.bincount(part).argmax()).tolist():  # of two parts one isn't the largest
        if (part == part[x]).all():
            break
        held = np.zeros(value.max() + 1, np.int64)
        held[value[start[x] : start[x] + length[x]]] = 1
        hit = _alike(np.add.reduceat(held[value], start), length + length[x], least) & (part != part[x])
        for y in np.flatnonzero(hit).tolist():
            if part[y] != part[x]:
                found.append((x, y))
                part[part == part[y]] = part[x]
    return found


def nodes_of(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, key, node, fp, bands): one row per row of non-null id.

    fp is the text's fingerprint (see simhash.fingerprint), bands are those of its set; sets that are too small to have a
    different one at the similarity have none.
    """
    least = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, bands = [], [], []
            for x in batch.column(2):
                hashes = list(simhash._hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, 42))
                members = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
                node.append(node_of(members))
                fp.append(simhash.folded(hashes))
                bands.append(bands_of(members) if _alike(len(members), 2 * len(members) + 1, least) and hashes else np.zeros(0, np.uint64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "key", "node", "fp", "bands"])

    small_batches(docs.sparkSession)
    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(f"`{text_col}`")
    narrow = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), row_key(text).alias("key"), text.cast("binary").alias("data"))
    return narrow.mapInArrow(run, f"id {kind}, key long, node long, fp long, bands array<long>")


def texts_of(docs: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """(node, data) of chosen (node, id, key): the text of that row."""
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(text).alias("key"), text.cast("binary").alias("data"))
    own = narrow.join(sized(chosen.select("node", "id", "key")), ["id", "key"]).select("node", "data")
    return own.dropDuplicates(["node"])  # rows repeated in id and text


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, least: Fraction) -> Iterator[pa.RecordBatch]:
    """Links among (a, b, x, y), sorted by b, x and y the texts of a and b."""
    held: dict[int, np.ndarray] = {}

    def members(node: int, text: pa.Scalar) -> np.ndarray:
        found = held.pop(node, None)
        held[node] = shingle_set(text.as_buffer().to_pybytes(), shingle) if found is None else found
        if len(held) > HELD:
            del held[next(iter(held))]  # that used longest ago
        return held[node]

    for batch in batches:
        ok = []
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            one, two = members(a, x), members(b, y)
            ok.append(bool(_alike(len(np.intersect1d(one, two, assume_unique=True)), len(one) + len(two), least)))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _settled(batches: Iterator[pa.RecordBatch], shingle: int, least: Fraction) -> Iterator[pa.RecordBatch]:
    """Links within buckets of (bucket, node, part, data), sorted by bucket; a bucket may go on in the next batch."""
    bucket, rows = None, []

    def links() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            part = np.unique([r[1] for r in rows], return_inverse=True)[1]
            found = forest([r[2] for r in rows], part, least)
            yield pa.RecordBatch.from_arrays([pa.array([rows[x][0] for x, _ in found], pa.int64()), pa.array([rows[y][0] for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for b, n, p, m in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
            if b != bucket:
                yield from links()
                bucket, rows = b, []
            rows.append((n, p, shingle_set(m.as_buffer().to_pybytes(), shingle)))
    yield from links()


def verified(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b): the pairs of met (a, b, thinned, known), those known excepted, of Jaccard similarity or more.

    nodes: (node, id, key), one row a node, id and key those of a row that has it.
    """
    least = Fraction(str(similarity))
    with shuffles_dropped(docs.sparkSession):
        pairs = durable(met.where("not known").select("a", "b").distinct())
        held = durable(texts_of(docs, id_col, text_col, nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")))
        one, two = held.select(F.col("node").alias("a"), F.col("data").alias("x")), held.select(F.col("node").alias("b"), F.col("data").alias("y"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").sortWithinPartitions("b")
        return durable(both.mapInArrow(lambda it: _verified(it, shingle, least), "a long, b long"))


def settled(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, nodes: DataFrame, trees: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): the links near, and more that connect what all links among the nodes that trees (a, b) connect do.

    nodes: as in verified.
    """
    trees = durable(trees.distinct())
    if trees.isEmpty():
        return near
    least = Fraction(str(similarity))
    buckets, parts = components(trees).withColumnRenamed("root", "bucket"), components(near)
    rest = durable(buckets.join(parts, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("part")))
    open_ = rest.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
    with shuffles_dropped(docs.sparkSession):
        rest = durable(rest.join(open_, "bucket"))
        held = texts_of(docs, id_col, text_col, nodes.join(rest.select("node"), "node"))
        left = rest.join(held, "node").select("bucket", "node", "part", "data")
        more = left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _settled(it, shingle, least), "a long, b long")
        return near.unionByName(durable(more))
