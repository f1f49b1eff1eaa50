"""Deterministic samples of true pairs, and their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import tags
from ..functions.text import conservative
from .ordering import sample


def positive_sample(links: DataFrame, first: DataFrame, others: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """The n links of smallest seeded hash with both records' fields. Ids without a record drop out, as in an inner join."""
    drawn = F.broadcast(sample(links, ["sid", "tid"], n, seed))  # at most n rows
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.col("country").alias(f"{p}_country"), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"))
    out = side(first, "sid", "s1").join(drawn, "sid").join(side(others, "tid", "secondary"), "tid")
    return out.select("sid", "tid", "s1_country", "secondary_country", "s1_name", "s1_address", "secondary_name", "secondary_address")


def tagged(pairs: DataFrame) -> DataFrame:
    """The sample with heuristic_tags."""
    norm = [conservative(F.col(c)).alias(f"__{c}") for c in ("s1_name", "s1_address", "secondary_name", "secondary_address")]
    views = pairs.select("*", *norm)
    found = tags(F.col("__s1_name"), F.col("__s1_address"), F.col("__secondary_name"), F.col("__secondary_address"))
    return views.withColumn("heuristic_tags", found).select(*pairs.columns, "heuristic_tags")


def tag_counts(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.split("heuristic_tags", ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("pairs"))
