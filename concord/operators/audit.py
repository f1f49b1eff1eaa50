"""Profiles and integrity checks of the sources and the truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing, trim_spaces

TOLERATED = ("secondary_ids_with_multiple_s1", "cross_split_id_overlap")


def profile(source: DataFrame, prefix: str) -> DataFrame:
    """One row: rows, duplicate and invalid ids, and per field missing values, lengths and words.

    Null ids count as duplicates and as invalid. Quantiles are exact and interpolated. Lengths and words leave nulls out.
    """
    aggs = [
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("entity_id")).alias("duplicate_ids"),
        F.count_if(F.col("entity_id").isNull() | ~F.startswith("entity_id", F.lit(f"{prefix}-"))).alias("invalid_ids"),
    ]
    aggs += [F.count_if(F.coalesce(is_missing(F.col(f)), F.lit(True))).alias(f"{f}_missing") for f in ("business_name", "business_address", "country")]
    for field in ("business_name", "business_address"):
        size = F.length(field)
        words = F.size(F.split(trim_spaces(F.col(field)), r"[ \t\n\f\r]+"))
        aggs += [F.avg(size).alias(f"{field}_mean_chars"), F.percentile(size, 0.5).alias(f"{field}_median_chars"), F.percentile(size, 0.95).alias(f"{field}_p95_chars")]
        aggs.append(F.avg(F.when(F.col(field).isNotNull(), words)).alias(f"{field}_mean_tokens"))
    return source.agg(*aggs)


def country_counts(source: DataFrame) -> DataFrame:
    """Rows by country; missing countries are a group."""
    return source.groupBy("country").agg(F.count("*").alias("rows"))


def collisions(source: DataFrame, field: str) -> DataFrame:
    """One row: how many values occur in more than one row, and in how many rows."""
    groups = source.where(~is_missing(F.col(field))).groupBy(field).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("distinct_colliding_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected_entities"))


def match_counts(truth: DataFrame) -> DataFrame:
    """Entities by number of listed matches."""
    n = F.when(F.col("matched_entity_ids").isNull(), 0).otherwise(F.size(F.split("matched_entity_ids", ",")))
    return truth.groupBy(n.cast("long").alias("matches")).agg(F.count("*").alias("entities"))


def source_mix(truth: DataFrame) -> DataFrame:
    """Entities by the secondary sources their matches come from."""
    ids = F.col("matched_entity_ids")
    two, three = F.contains(ids, F.lit("S2-")), F.contains(ids, F.lit("S3-"))
    mix = F.when(ids.isNull(), "singleton").when(two & three, "mixed").when(two, "S2-only").otherwise("S3-only")
    return truth.groupBy(mix.alias("source_mix")).agg(F.count("*").alias("entities"))


def integrity(train: list[DataFrame], test: list[DataFrame], truth: DataFrame, links: DataFrame) -> DataFrame:
    """(check_name, offenders): seven counts, all zero for sound data. train and test: the three sources each."""
    ids = lambda df: df.select("entity_id")
    every = lambda parts: reduce(DataFrame.unionByName, map(ids, parts))
    count = lambda name, df: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("offenders"))
    s1 = ids(train[0])
    checks = [
        truth.agg(F.lit("truth_duplicate_s1").alias("check_name"), (F.count("*") - F.count_distinct("source1_entity_id")).alias("offenders")),
        count("missing_truth_s1", s1.join(truth, s1["entity_id"] == truth["source1_entity_id"], "left_anti")),
        count("unknown_truth_s1", truth.join(s1, truth["source1_entity_id"] == s1["entity_id"], "left_anti")),
        count("duplicate_truth_links", links.groupBy("sid", "tid").count().where("count > 1")),
        count("unknown_truth_targets", links.join(every(train[1:]).withColumnRenamed("entity_id", "tid"), "tid", "left_anti")),
        count("secondary_ids_with_multiple_s1", links.groupBy("tid").agg(F.count_distinct("sid").alias("n")).where("n > 1")),
        count("cross_split_id_overlap", every(train).join(every(test), "entity_id")),
    ]
    return reduce(DataFrame.unionByName, checks)


def critical(checks: dict[str, int], profiles: dict[str, dict]) -> list[str]:
    """What must stop a run: every failed check but the tolerated two, and sources with duplicate or invalid ids."""
    failed = [k for k, n in checks.items() if n and k not in TOLERATED]
    return failed + [f"{name}: duplicate or invalid ids" for name, p in profiles.items() if p["duplicate_ids"] or p["invalid_ids"]]
