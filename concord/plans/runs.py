"""Whole runs over a dataset folder: audit, exact baseline, positive sample. Reports are small and written on the driver."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import blocking, export, ordering, sampling, scoring, validate
from ..sources import sinks, tables

SPLITS = ("train", "test")


def _folder(root: str, name: str) -> Path:
    path = Path(root) / name
    path.mkdir(parents=True, exist_ok=True)
    return path


def audit(spark: SparkSession, root: str) -> dict:
    """Profiles all sources, checks integrity, writes reports/data_audit.json and .md, and raises on what is critical
    (after the reports are written)."""
    began, data = perf_counter(), tables.read_dataset(spark, root)
    report: dict = {"sources": {}, "integrity": {}}
    for split in SPLITS:
        for i in (1, 2, 3):
            name = f"{split}_source{i}"
            source = data[name]
            info = tables.rows(A.profile(source, f"S{i}"))[0] | {"path": f"{root}/dataset/{split}/{name}.tsv", "schema": tables.describe(source)}
            info["countries"] = tables.rows(A.country_counts(source).orderBy(F.asc_nulls_last("country")))
            if i == 1:
                info["collisions"] = {f: tables.rows(A.collisions(source, f))[0] for f in ("business_name", "business_address")}
            report["sources"][name] = info
    truth = data["train_ground_truth"]
    report["truth_match_counts"] = tables.rows(A.match_counts(truth).orderBy("matches"))
    report["truth_source_mix"] = tables.rows(A.source_mix(truth).orderBy("source_mix"))
    parts = {split: [data[f"{split}_source{i}"] for i in (1, 2, 3)] for split in SPLITS}
    report["integrity"] = {r["check_name"]: r["offenders"] for r in A.integrity(parts["train"], parts["test"], truth, data["truth_links"]).collect()}
    report["runtime_seconds"] = round(perf_counter() - began, 2)
    out = _folder(root, "reports")
    sinks.write_json(report, str(out / "data_audit.json"))
    lines = [[n, s["rows"], s["duplicate_ids"], s["business_name_missing"], s["business_address_missing"]] for n, s in report["sources"].items()]
    total = report["sources"]["train_source1"]["rows"]
    single = sum(r["entities"] for r in report["truth_match_counts"] if r["matches"] == 0)
    checks = "\n".join(f"- {k}: {n:,}" for k, n in report["integrity"].items())
    table = sinks.markdown_table(("Source", "Rows", "Duplicate IDs", "Missing name", "Missing address"), lines)
    sinks.write_text(f"# Data audit\n\n{table}\n\nSingletons: {single:,} of {total:,} ({single / max(1, total):.2%}).\n\n## Integrity checks\n\n{checks}\n\nRuntime: {report['runtime_seconds']} s.", str(out / "data_audit.md"))
    if failed := A.critical(report["integrity"], report["sources"]):
        raise ValueError(f"integrity failures, see the report: {failed}")
    return report


def _gate(root: str) -> None:
    path = Path(root) / "reports" / "data_audit.json"
    if not path.exists():
        raise ValueError("run the audit first")
    report = tables.read_json(str(path))
    if failed := A.critical(report["integrity"], report["sources"]):
        raise ValueError(f"resolve integrity failures first: {failed}")


def metrics(first: DataFrame, others: DataFrame, links: DataFrame, candidates: DataFrame, folds: DataFrame) -> tuple[DataFrame, dict]:
    """Entity scores (persisted), and all summaries."""
    scores = scoring.entity_scores(first, links, candidates).persist()
    by = lambda df, key: tables.rows(df.orderBy(F.asc_nulls_last(key)))
    return scores, {
        "overall": tables.rows(scoring.reduction_ratio(scoring.summary(scores), others))[0],
        "by_country": by(scoring.summary(scores, "country"), "country"),
        "by_match_count": by(scoring.summary(scores, scoring.match_bucket().alias("match_count")), "match_count"),
        "by_fold": by(scoring.by_fold(scores, folds), "fold"),
    }


def baseline(spark: SparkSession, root: str) -> dict:
    """The exact name-and-address baseline: scores on train, result files for test, validated; reports and a log line.

    Raises where the audit failed, candidates repeat or are unknown, or the validator has any finding.
    """
    began = perf_counter()
    _gate(root)
    data = tables.read_dataset(spark, root)
    reports, log, output = _folder(root, "reports"), _folder(root, "experiments"), _folder(root, "output")
    folds = ordering.folds(data["train_source1"]).persist()
    sinks.write_tsv(folds.select(F.col("sid").alias("source1_entity_id"), F.col("fold").cast("string").alias("fold")), str(log / "folds.tsv"), "source1_entity_id")
    others, candidates = {}, {}
    for split in SPLITS:
        others[split] = data[f"{split}_source2"].unionByName(data[f"{split}_source3"])
        norm = [blocking.normalize(df) for df in (data[f"{split}_source1"], others[split])]
        candidates[split] = blocking.exact_candidates(*norm).persist()
        if not blocking.duplicate_pairs(candidates[split]).isEmpty():
            raise ValueError("duplicate candidate links")
    scores, result = metrics(data["train_source1"], others["train"], data["truth_links"], candidates["train"], folds)
    sinks.write_rows(tables.rows(scoring.error_sample(scores)), str(reports / "baseline_errors.tsv"), ["sid"])
    causes = tables.rows(scoring.error_causes(data["truth_links"], candidates["train"]))[0]
    sinks.write_text("# Error analysis\n\n" + "\n".join(f"- {k}: {n:,}" for k, n in causes.items()), str(reports / "error_analysis.md"))
    if not blocking.invalid_pairs(candidates["test"], data["test_source1"], others["test"]).isEmpty():
        raise ValueError("unknown or invalid candidate ids")
    files = {"candidate_pairs.tsv": ("candidate_entity_ids", False), "matching_results.tsv": ("matched_entity_ids", True)}
    for name, (column, accepted) in files.items():
        sinks.write_tsv(export.id_lists(data["test_source1"], candidates["test"], column, accepted), str(output / name), "source1_entity_id")
    findings = tables.rows(validate.validate(spark, str(output / "matching_results.tsv"), str(output / "candidate_pairs.tsv"), f"{root}/dataset/test", check_ids=True))
    sinks.write_text("\n".join(map(str, findings)) or "no findings", str(reports / "baseline_validator.txt"))
    if findings:
        raise RuntimeError("the validator has findings, see reports/baseline_validator.txt")
    run_id = datetime.now(timezone.utc).strftime("E01_%Y%m%dT%H%M%S%fZ")
    result |= {"runtime_seconds": round(perf_counter() - began, 2), "evaluation_scope": "all labelled entities, a fixed rule, nothing fitted", "policy": "equal non-empty name and address; accepted unless both countries are known and differ", "run_id": run_id}
    sinks.write_json(result, str(reports / "baseline_metrics.json"))
    sinks.write_json(result, str(log / f"{run_id}.json"))
    sinks.append_log({"experiment": "E01", "split": "train", "blocker": "exact-name-and-address", "matcher": "country-rule"} | result["overall"] | {"runtime_seconds": result["runtime_seconds"]}, str(log / "results.csv"))
    for df in (folds, scores, *candidates.values()):
        df.unpersist()
    return result


def positive_sample(spark: SparkSession, root: str, n: int = 2000) -> dict:
    """Writes the tagged sample of true pairs and the counts of its tags."""
    data = tables.read_dataset(spark, root)
    others = reduce(DataFrame.unionByName, [data[f"train_source{i}"] for i in (2, 3)])
    drawn = sampling.tagged(sampling.positive_sample(data["truth_links"], data["train_source1"], others, n)).persist()
    rows = tables.rows(drawn.orderBy(ordering.seeded(F.col("sid"), F.col("tid"))))
    out = _folder(root, "reports")
    sinks.write_rows(rows, str(out / "positive_pair_sample.tsv"), drawn.columns)
    result = {"sample_size": len(rows), "seed": 42, "method": "smallest seeded md5 over all true links", "tags": {r["tag"]: r["pairs"] for r in sampling.tag_counts(drawn).collect()}}
    sinks.write_json(result, str(out / "positive_pair_sample.json"))
    drawn.unpersist()
    return result
