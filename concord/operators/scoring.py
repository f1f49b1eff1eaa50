"""Exact entity-level scores, and summaries of them overall and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import sample


def f05(truth: Column, predicted: Column, tp: Column) -> Column:
    """F0.5 of one entity from its counts; without truth, 1 for no prediction and else 0."""
    return F.when(truth == 0, (predicted == 0).cast("double")).otherwise(5.0 * tp.cast("double") / (5 * tp + (truth - tp) + 4 * (predicted - tp)))


def entity_scores(first: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sid, country, truth_count, candidate_count, pred_count, covered, tp, f05): one row per S1 row.

    Links and candidates meet in one aggregate by pair and one by sid, so that no join fans out.
    """
    pairs = candidates.select("sid", "tid", F.lit(0).alias("t"), F.lit(1).alias("c"), F.col("accepted").cast("int").alias("p"))
    pairs = pairs.unionByName(links.select("sid", "tid", F.lit(1).alias("t"), F.lit(0).alias("c"), F.lit(0).alias("p")))
    pairs = pairs.groupBy("sid", "tid").agg(*[F.sum(x).alias(x) for x in "tcp"])
    # a repeated link meets each repeated candidate, as in a join
    sums = pairs.groupBy("sid").agg(F.sum("t").alias("truth_count"), F.sum("c").alias("candidate_count"), F.sum("p").alias("pred_count"), F.sum(F.col("t") * F.col("c")).alias("covered"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    counts = ("truth_count", "candidate_count", "pred_count", "covered", "tp")
    joined = first.select(F.col("entity_id").alias("sid"), "country").join(sums, "sid", "left").na.fill(0, list(counts))
    return joined.select("sid", "country", *counts, f05(F.col("truth_count"), F.col("pred_count"), F.col("tp")).alias("f05"))


def _share(part: str, whole: str) -> Column:
    return F.sum(part).cast("double") / F.nullif(F.sum(whole), F.lit(0))


def measures() -> list[Column]:
    """The summary block: rates are null where their denominator is empty."""
    full = (F.col("covered") == F.col("truth_count")).cast("double")
    alone = F.col("truth_count") == 0
    return [
        F.count("*").alias("entities"),
        F.avg("f05").alias("macro_f05"),
        _share("tp", "pred_count").alias("link_precision"),
        _share("tp", "truth_count").alias("link_recall"),
        _share("covered", "truth_count").alias("candidate_recall"),
        F.avg(full).alias("all_true_matches_covered"),
        F.avg(F.when(~alone, full)).alias("nonsingleton_all_matches_covered"),
        F.avg(F.when(alone, (F.col("pred_count") > 0).cast("double"))).alias("singleton_fp_rate"),
        F.sum("candidate_count").alias("candidate_pairs"),
        F.avg("candidate_count").alias("mean_candidates"),
        F.percentile("candidate_count", 0.5).alias("median_candidates"),
        F.percentile("candidate_count", 0.95).alias("p95_candidates"),
    ]


def match_bucket() -> Column:
    return F.when(F.col("truth_count") == 0, "zero").when(F.col("truth_count") == 1, "one").otherwise("multiple")


def summary(scores: DataFrame, *by: Column | str) -> DataFrame:
    return scores.groupBy(*by).agg(*measures())


def by_fold(scores: DataFrame, folds: DataFrame) -> DataFrame:
    return summary(scores.join(folds, "sid"), "fold")


def reduction_ratio(overall: DataFrame, others: DataFrame) -> DataFrame:
    """The overall summary with the share of all pairs that blocking avoids."""
    pairs = F.col("entities").cast("double") * others.agg(F.count("*").cast("double")).scalar()
    return overall.withColumn("reduction_ratio", 1.0 - F.col("candidate_pairs") / pairs)


def error_sample(scores: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """The n imperfect entities of smallest seeded hash, and the stage that failed first."""
    first = F.when(F.col("covered") < F.col("truth_count"), "blocking").otherwise("decision")
    return sample(scores.where("f05 < 1").withColumn("first_failure", first), ["sid"], n, seed).drop("candidate_count")


def error_causes(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: true links no candidate covers, and true candidates that were rejected."""
    met = links.join(candidates, ["sid", "tid"], "left")
    present = F.col("tid").isNotNull()
    return met.agg(F.count_if(present & F.col("accepted").isNull()).alias("missed_by_blocking"), F.count_if(present & ~F.col("accepted")).alias("rejected_true_candidates"))


def evaluate(truth: DataFrame, predicted: DataFrame) -> dict:
    """Scores of two (sid, ids array) tables as a dict; raises unless both have the same, non-empty set of sids."""
    both = truth.select("sid", F.col("ids").alias("t")).join(predicted.select("sid", F.col("ids").alias("p")), "sid", "full")
    counts = both.select(F.col("t").isNull().alias("no_t"), F.col("p").isNull().alias("no_p"), F.size("t").alias("truth_count"), F.size("p").alias("pred_count"), F.size(F.array_intersect("t", "p")).alias("tp"))
    counts = counts.withColumn("f05", f05(F.col("truth_count"), F.col("pred_count"), F.col("tp")))
    alone = F.col("truth_count") == 0
    row = counts.agg(F.count("*").alias("entities"), F.count_if(F.col("no_t") | F.col("no_p")).alias("apart"), F.avg("f05").alias("macro_f05"), _share("tp", "pred_count").alias("link_precision"), _share("tp", "truth_count").alias("link_recall"), F.avg(F.when(alone, (F.col("pred_count") > 0).cast("double"))).alias("singleton_fp_rate")).first().asDict()
    if row.pop("apart"):
        raise ValueError("truth and predictions must have the same S1 ids")
    if not row["entities"]:
        raise ValueError("nothing to evaluate")
    return row
