"""URL filtering with Bloom filter cascades.

A rule is host + path, like net/de/: it fits the host and all its subdomains if the path starts with the rule's. Every
URL yields a few candidate keys (host suffixes with as many labels as some rule's host, times path prefixes as long as some
rule's path). The distinct candidate keys of the corpus are the key universe. A cascade holds a set of listed keys exactly
over this universe: level 1 encodes the listed keys, level 2 the universe's keys that level 1 takes for listed wrongly,
level 3 the listed keys that level 2 takes for such, and so on until a level has no false positive. A key's membership is
the parity of the first level that doesn't hold it. Lookups need no join: the bit tables have a size that follows from the
number of rules, and are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

SALT = 0x9E3779B97F4A7C15


@dataclass
class Cascade:
    """levels: (bits, hashes) by level; bits as packed bytes."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys (two 64-bit hashes each) are listed; exact for the keys of the universe."""
        answer = np.zeros(len(h1), bool)
        live = np.arange(len(h1))
        for number, (bits, hashes) in enumerate(self.levels):
            live = live[_test(bits, hashes, number, h1[live], h2[live])]
            answer[live] = number % 2 == 0
        return answer


def _places(bits: int, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    a = h1.view(np.uint64) ^ np.uint64((level * SALT) % 2**64)
    b = h2.view(np.uint64) | np.uint64(1)
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)]).astype(np.int64)


def _test(table: np.ndarray, hashes: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _places(len(table) * 8, hashes, level, h1, h2)
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _level(keys: DataFrame, number: int, level: int, fpp: float) -> tuple[np.ndarray, int]:
    """A Bloom filter of the hashed keys, built where the keys are: tasks send the bits they set, added up by byte."""
    bits = max(64, math.ceil(-number * math.log(fpp) / math.log(2) ** 2))
    bits += -bits % 8
    hashes = max(1, round(-math.log2(fpp)))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(_places(bits, hashes, level, b["h1"].to_numpy(), b["h2"].to_numpy()))
            yield pd.DataFrame({"byte": at >> 3, "bit": np.left_shift(1, at & 7)})

    found = keys.mapInPandas(places, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    table = np.zeros(bits // 8, np.uint8)
    table[found["byte"].to_numpy(np.int64)] = found["bit"].to_numpy(np.uint8)
    return table, hashes


def _passing(keys: DataFrame, filled: tuple[np.ndarray, int], level: int) -> DataFrame:
    table, hashes = filled
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[_test(shared.value, hashes, level, b["h1"].to_numpy(), b["h2"].to_numpy())]

    return keys.mapInPandas(run, "h1 long, h2 long")


def build(universe: DataFrame, listed: DataFrame, max_levels: int = 64) -> Cascade:
    """A cascade that tells the keys of listed from all other keys of universe.

    Both have one column key; nulls and repeated rows are ignored, listed keys outside the universe count as part of it.
    The first level's rate follows from both sizes, so that the false positives left are about as many as the listed keys.
    Sizes on the driver: some 1.5 to 2 bytes a listed key, growing with the logarithm of universe over listed.
    """
    hashed = lambda df: df.where("key is not null").select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")).distinct()
    inside = durable(hashed(listed))
    outside = durable(hashed(universe).join(inside, ["h1", "h2"], "left_anti"))
    counts, out = {True: inside.count(), False: outside.count()}, Cascade()
    held, other, held_n = inside, outside, counts[True]
    if not held_n:
        return out
    fpp = min(0.5, max(1e-9, held_n * math.sqrt(0.5) / max(1, counts[False])))
    for level in range(max_levels):
        filled = _level(held, held_n, level, fpp)
        out.levels.append(filled)
        wrong = durable(_passing(other, filled, level))
        wrong_n = wrong.count()
        if not wrong_n:
            return out
        held, other, held_n, fpp = wrong, held, wrong_n, 0.5
    raise RuntimeError("the cascade did not settle")


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty where there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Keys that a rule could have for this URL, the longest host suffix and then the longest path first."""
    out = []
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in rules}, reverse=True)
    for labels, length in shapes:
        suffix = F.substring_index(host, ".", -labels)
        key = F.concat(suffix, F.substring(path, 1, length)) if length else suffix
        fits = (F.length(path) >= length) & (F.size(F.split(host, r"\.")) >= labels) & (F.length(host) > 0)
        out.append(F.when(fits, F.struct(key.alias("key"), F.length(key).alias("n"), F.length(suffix).alias("h"))))
    return F.filter(F.array(*out).cast("array<struct<key:string,n:int,h:int>>"), lambda x: x.isNotNull())


def judge(pages: DataFrame, allow: Sequence[tuple[str, str]], block: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), one row per input row.

    allow and block are (host, path) rules; they are bounded lists held by the caller. Of the rules that fit, the longest
    wins (then the longer host); where a key is in both lists, allow wins. Where no rule fits, the key is in neither
    cascade and the verdict is otherwise. Null urls and those without :// have an empty host, which no rule fits. Extra
    columns are ignored.
    """
    spark, rules = pages.sparkSession, [*allow, *block]
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    parts = durable(parts.withColumn("keys", candidates(F.col("host"), F.col("path"), rules)))
    universe = parts.select(F.explode("keys").alias("k")).select("k.key").distinct()
    table = lambda part: spark.createDataFrame([(h + p,) for h, p in part], "key string")
    shared = spark.sparkContext.broadcast((build(universe, table(allow)), build(universe, table(block))))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        allowed, blocked = shared.value
        for b in batches:
            counts = b["h1"].str.len().fillna(0).to_numpy(int)
            h1, h2 = (np.concatenate([np.zeros(0, np.int64), *b[c]]).astype(np.int64) for c in ("h1", "h2"))
            said = np.where(allowed.holds(h1, h2), 1, np.where(blocked.holds(h1, h2), 2, 0))
            yield pd.DataFrame({"id": b["id"], "host": b["host"], "path": b["path"], "keys": b["keys"], "hosts": b["hosts"], "said": np.split(said, np.cumsum(counts)[:-1]) if len(b) else []})

    kind = pages.schema[id_col].dataType.simpleString()
    asked = parts.select("id", "host", "path", F.transform("keys", lambda k: k["key"]).alias("keys"), F.transform("keys", lambda k: k["h"]).alias("hosts"), F.transform("keys", lambda k: F.xxhash64(k["key"])).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k["key"])).alias("h2"))
    told = asked.mapInPandas(look, f"id {kind}, host string, path string, keys array<string>, hosts array<int>, said array<int>")
    at = lambda column, i: F.element_at(column, i + 1)
    fits = F.filter(F.transform("keys", lambda k, i: F.struct(F.length(k).alias("n"), at("hosts", i).alias("h"), k.alias("key"), at("said", i).alias("s"))), lambda x: x["s"] > 0)
    best = F.try_element_at(F.array_sort(fits), F.lit(-1))
    told = told.withColumn("best", best)
    verdict = F.when(F.col("best.s") == 1, "allow").when(F.col("best.s") == 2, "block").otherwise(otherwise)
    return told.select("id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
