"""Stupid-backoff scores of documents under the counts of the whole corpus.

S(w | v) = c(v w) / c(v) where the bigram v w occurs at least min_count times, else backoff * c(w) / N. A document's score
is the sum of ln S over its words but the first.

ln S is a value of the word, ln(backoff * c(w) / N), plus a correction where the bigram was seen, so a score is the sum of
the values of all words and seen bigrams of a document: n-grams joined to a table of values. Four passes:

1. texts are split once, and written as the hashes of their words in chunks of documents;
2. words are counted;
3. bigrams are counted by hash; those seen get their words' counts by joins, and so their corrections;
4. n-grams are exploded by document, as one hash each, joined to the values in hash partitions and summed by document.

Words and bigrams with a share of min_share or more (at most 1 / min_share of each) are frequent. Their values are broadcast
and summed where the document is read, so no frequent key is ever shuffled and no partition is hot. The last two
passes run once for each of some slices of the hashes, so that only one slice's shuffle is on disk at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, small_batches

MIX = np.uint64(0x9E3779B97F4A7C15)
NO_WORD = 0  # stands for the first word where a row is about one word
TWO_LEVELS = "spark.sql.codegen.aggregate.map.twolevel.enabled"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPLITS = "spark.sql.files.minPartitionNum"
TASK = 4_000_000  # words that a task of the later passes reads, about
CHUNKS = "hashes binary, places binary, sizes binary, ids array<long>"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) ^ (b.astype(np.uint64) * MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Whole documents with some size words together: their distinct words' hashes, the place of each word among these, the
    number of words of each document, and the ids."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)  # places in order of appearance, without a step of Python a word
    words: list[np.ndarray] = []
    ids: list[int | None] = []
    held = 0

    def told() -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in known), np.int64, len(known))
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (hashes, np.concatenate(words), sizes)]
        return pa.RecordBatch.from_arrays([*blobs, pa.array([ids], pa.list_(pa.int64()))], ["hashes", "places", "sizes", "ids"])

    for batch in batches:
        for id_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = data.as_buffer().to_pybytes().split() if data.is_valid else []
            words.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            ids.append(id_)
            held += len(found)
            if held >= size:
                yield told()
                known, held = defaultdict(count().__next__), 0
                words.clear(), ids.clear()
    if words:
        yield told()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(hashes, place of each word, document of each word, ids) of each chunk."""
    for batch in batches:
        for at in range(batch.num_rows):
            hashes, places, sizes = (np.frombuffer(x.as_buffer(), kind) if len(x.as_py()) else np.zeros(0, kind) for x, kind in ((batch.column(0)[at], np.int64), (batch.column(1)[at], np.int32), (batch.column(2)[at], np.int32)))
            yield hashes, places, np.repeat(np.arange(len(sizes)), sizes), batch.column(3)[at].values


def _look_up(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each sought value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Two codes of frequent words as one number; -1 where a word is rare."""
    return np.where((v > 0) & (w > 0), v << 32 | w, -1)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for what is written meanwhile."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2, backoff: float = 0.4, min_share: float = 1e-6, slices: int = 2, chunk: int = 1_000_000, rows: int = 2_000_000) -> DataFrame:
    """(id, n_scored, log_score), one row per distinct id (of an integer type; null counts as an id).

    Rows that share an id are scored as one document, without a bigram across rows. Texts of fewer than two words, empty
    and null ones have 0 and 0. Words are told apart by 63-bit hashes, and their bigrams by 64-bit ones of both in the last
    pass. Extra columns are ignored.

    A chunk holds that many words and one document's more at most; rows is about how many n-grams a partition gets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data"))

    # shuffles are deleted as soon as what they were for is written, as their files count for more than the tables
    # a first small map for hot keys is of no use, as each chunk has told its repeated keys as one row
    settings = {CLEAN_UP: "true", TWO_LEVELS: "false"}

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        with _settings(spark, settings):
            df.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path), path

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, places, _, _ in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.bincount(places, minlength=len(hashes)))], ["h", "n"])

    chunks, chunks_path = written(data.mapInArrow(lambda batches: _chunks(batches, chunk), CHUNKS), "chunks")
    words, words_path = written(chunks.mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(1.0, total * min_share)
    settings[SPLITS] = str(max(1, math.ceil(total / TASK)))
    base = math.log(backoff) - math.log(max(1, total))
    # codes: a frequent word's place among them, from 1; any other is -1 - hash
    frequent = words.where(F.col("n") >= least).toPandas().sort_values("h")
    hashes, counts = frequent["h"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((hashes, np.append(0.0, np.log(counts) + base)))
    often = F.broadcast(spark.createDataFrame(pa.table({"code": pa.array(np.arange(1, len(hashes) + 1)), "c": pa.array(counts)})))
    rare = words.where(F.col("n") < least).select((-1 - F.col("h")).alias("code"), F.col("n").alias("c"))

    def bigrams(hashes: np.ndarray, places: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second word's code, and document, of all bigrams."""
        at, there = _look_up(shared.value[0], hashes)
        code = np.where(there, at + 1, -1 - hashes)[places]
        same = docs[1:] == docs[:-1]
        return code[:-1][same], code[1:][same], docs[1:][same]

    def count_bigrams(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        for hashes, places, docs, _ in _opened(batches):
            v, w, _ = bigrams(hashes, places, docs)
            key = _mix(v, w)
            mine = np.flatnonzero(key % np.uint64(slices) == part)
            mine = mine[np.argsort(key[mine])]
            first = np.flatnonzero(np.append(True, key[mine[1:]] != key[mine[:-1]])[: len(mine)])
            n = np.diff(np.append(first, len(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(v[mine[first]]), pa.array(w[mine[first]]), pa.array(n)], ["v", "w", "n"])

    seen_paths = []
    for part in range(slices):
        found = chunks.mapInArrow(lambda batches, part=part: count_bigrams(batches, part), "v long, w long, n long")
        found = found.groupBy("v", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        seen_paths.append(written(found, f"bigrams-{part}")[1])
    seen = spark.read.parquet(*seen_paths)

    parts = max(1, math.ceil(total / rows / slices))
    rarer = rare.withColumnsRenamed({"code": "key", "c": "c_rare"}).repartition(parts, "key").hint("shuffle_hash")

    def counted(df: DataFrame, word: str, other: str) -> DataFrame:
        """df with the count of a word. Rows of a frequent one have it from the broadcast, and go through the shuffle under their
        other word as a key that no rare word has."""
        key = F.when(F.col(word) < 0, F.col(word)).otherwise(F.col(other).bitwiseAND((1 << 63) - 1))
        met = df.join(often.withColumnsRenamed({"code": word, "c": "c_often"}), word, "left").withColumn("key", key)
        met = met.repartition(parts, "key").join(rarer, "key", "left")
        return met.withColumn(f"c_{word}", F.coalesce("c_often", "c_rare")).drop("key", "c_often", "c_rare")

    worth = F.log("n") - F.log("c_v") - F.log("c_w") - F.lit(base)
    values, values_path = written(counted(counted(seen, "v", "w"), "w", "v").select("v", "w", "n", worth.alias("value")), "values")
    for path in seen_paths:
        discard(spark, path)
    top = values.where(F.col("n") >= least).toPandas()
    keys = _pair(top["v"].to_numpy(np.int64), top["w"].to_numpy(np.int64))
    order = np.argsort(keys)
    paired = spark.sparkContext.broadcast((keys[order], top["value"].to_numpy(np.float64)[order]))
    others = values.where(F.col("n") < least).select("v", "w", "value")
    others = others.unionByName(rare.select(F.lit(NO_WORD).cast("long").alias("v"), F.col("code").alias("w"), (F.log("c") + base).alias("value")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _mix(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2)], ["key", "value"])

    def explode(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        """The n-grams of a slice that aren't frequent, by document, and a row of the frequent ones' sum for each document."""
        for hashes, places, docs, ids in _opened(batches):
            v, w, doc = bigrams(hashes, places, docs)
            key, own = _mix(v, w), np.zeros(len(ids))
            if part == 0:
                own += np.bincount(doc, np.where(w > 0, shared.value[1][np.maximum(w, 0)], 0.0), len(ids))
            mine = np.flatnonzero(key % np.uint64(slices) == part)
            at, there = _look_up(paired.value[0], _pair(v[mine], w[mine]))
            own += np.bincount(doc[mine[there]], paired.value[1][at[there]], len(ids))
            mine, lone = mine[~there], np.flatnonzero((w < 0) & (w % slices == part))
            gram_key = np.append(key[mine], _mix(np.full(len(lone), NO_WORD), w[lone])).view(np.int64)
            gram_doc = np.append(doc[mine], doc[lone])
            order = np.argsort(gram_doc, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(gram_key[order]), ids.take(pa.array(gram_doc[order])), pa.nulls(len(order), pa.float64())], ["key", "id", "known"])
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(some), ids.take(pa.array(some)), pa.array(own[some])], ["key", "id", "known"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, ids in zip(batch.column(0), batch.column(1), strict=True):
                n = np.maximum(np.frombuffer(sizes.as_buffer(), np.int32).astype(np.int64) - 1, 0)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n)], ["id", "n"])

    table = others.mapInArrow(keyed, "key long, value double").repartition(parts, "key").hint("shuffle_hash")
    every = written(chunks.select("sizes", "ids").mapInArrow(lengths, "id long, n long"), "lengths")[0].select("id", "n", F.lit(0.0).alias("score"))
    for part in range(slices):
        grams = chunks.mapInArrow(lambda batches, part=part: explode(batches, part), "key long, id long, known double")
        met = grams.repartition(parts, "key").join(table, "key", "left").select("id", F.coalesce("known", "value").alias("score")).where("score is not null")
        told = written(met.groupBy("id").agg(F.sum("score").alias("score")), f"scores-{part}")[0]
        every = every.unionByName(told.select("id", F.lit(0).cast("long").alias("n"), "score"))
    discard(spark, chunks_path)
    discard(spark, words_path)
    discard(spark, values_path)
    return every.groupBy("id").agg(F.sum("n").alias("n_scored"), F.sum("score").alias("log_score"))
