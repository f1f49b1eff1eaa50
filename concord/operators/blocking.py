"""The exact blocker and its decision column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import conservative, is_ascii


_VIEWS = {"business_name": "name_norm", "business_address": "address_norm", "country": "country_norm"}


def all_ascii(source: DataFrame) -> bool:
    """Whether normalize may leave Python out for this source; reads it once."""
    return source.where(~F.coalesce(is_ascii(F.concat_ws("", *_VIEWS)), F.lit(True))).isEmpty()


def normalize(source: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(entity_id, name_norm, address_norm, country_norm), never null but for the id. ascii_only: see all_ascii."""
    views = [conservative(F.col(c), ascii_only).alias(n) for c, n in _VIEWS.items()]
    return source.select("entity_id", *views)


def exact_candidates(first: DataFrame, others: DataFrame) -> DataFrame:
    """(sid, tid, accepted): pairs of equal non-empty name and address; accepted unless both countries are known and differ.

    Both sides are normalised. The empty-key filter stands on both sides so that missing values never meet in one task.
    """
    keyed = lambda df, i, c: df.where((F.col("name_norm") != "") & (F.col("address_norm") != "")).select("name_norm", "address_norm", F.col("entity_id").alias(i), F.col("country_norm").alias(c))
    pairs = keyed(first, "sid", "c1").join(keyed(others, "tid", "c2"), ["name_norm", "address_norm"])
    return pairs.select("sid", "tid", ((F.col("c1") == F.col("c2")) | (F.col("c1") == "") | (F.col("c2") == "")).alias("accepted"))


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("sid", "tid").agg(F.count("*").alias("n")).where("n > 1")


def invalid_pairs(candidates: DataFrame, first: DataFrame, others: DataFrame) -> DataFrame:
    """Candidates of an unknown id on either side, or of a target without a secondary prefix."""
    known = candidates.join(first.select(F.col("entity_id").alias("sid")).distinct().withColumn("k1", F.lit(True)), "sid", "left")
    known = known.join(others.select(F.col("entity_id").alias("tid")).distinct().withColumn("k2", F.lit(True)), "tid", "left")
    prefix = F.startswith("tid", F.lit("S2-")) | F.startswith("tid", F.lit("S3-"))
    return known.where(F.col("k1").isNull() | F.col("k2").isNull() | ~prefix).select("sid", "tid")
