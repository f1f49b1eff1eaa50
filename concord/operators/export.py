"""Result lists: one row per S1 entity, its target ids in order, empty where it has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(first: DataFrame, candidates: DataFrame, column: str, accepted_only: bool) -> DataFrame:
    """(source1_entity_id, column). Candidates and matches come from the same table, so matches are a subset."""
    chosen = candidates.where(F.col("accepted") if accepted_only else F.lit(True))
    lists = chosen.groupBy(F.col("sid").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_list("tid")), ",").alias(column))
    ids = first.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(lists, "source1_entity_id", "left").na.fill("", [column])
