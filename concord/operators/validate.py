"""The output validator: every rule is a count of offenders with up to five examples, over any size of file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_ids, read_lines

MATCHING = ("source1_entity_id", "matched_entity_ids")
CANDIDATE = ("source1_entity_id", "candidate_entity_ids")
SHOWN = 5
SCHEMA = "file string, rule string, severity string, offenders long, examples array<string>"


def parsed(lines: DataFrame) -> DataFrame:
    """(line_number, sid, ids array, tabbed, blank) of raw (line_number, value) lines; the first tab alone divides."""
    value = F.regexp_replace("value", r"\r$", "")
    at = F.instr(value, "\t")
    rest = F.when(at > 0, value.substr(at + 1, F.length(value))).otherwise("")
    blank = lambda c: F.regexp_replace(c, r"\s+", "") == ""
    ids = F.when(blank(rest), F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return lines.select("line_number", F.when(at > 0, value.substr(F.lit(1), at - 1)).otherwise(value).alias("sid"), ids.alias("ids"), (at > 0).alias("tabbed"), blank(value).alias("blank"))


def _finding(file: str, rule: str, offenders: DataFrame, what: str, severity: str = "error") -> DataFrame:
    """One row of offenders, none if there are none; examples are the first by order (numbers as numbers), kept by a bounded
    top-k."""
    named = offenders.select(F.col(what).alias("x")).distinct()
    count = named.agg(F.count("*").alias("offenders"))
    first = named.orderBy("x").limit(SHOWN).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.cast("string")).alias("examples"))
    row = count.withColumn("examples", first.scalar()).where("offenders > 0")
    return row.select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "offenders", "examples")


def list_findings(rows: DataFrame, file: str, required: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Findings over the parsed lines after the header. required: (id) of S1; targets: (id) of S2 and S3, or None."""
    listed = rows.where("tabbed")
    seen = listed.select("sid").distinct()
    ids = listed.select("sid", F.explode("ids").alias("id"))
    own, known = F.startswith("id", F.lit("S1-")), F.startswith("id", F.lit("S2-")) | F.startswith("id", F.lit("S3-"))
    need = required.select(F.col("id").alias("sid")).distinct()
    out = [
        _finding(file, "malformed_row", rows.where(~F.col("tabbed") & ~F.col("blank")), "line_number"),
        _finding(file, "duplicate_row", listed.groupBy("sid").count().where("count > 1"), "sid"),
        _finding(file, "repeated_id", listed.where(F.size("ids") != F.size(F.array_distinct("ids"))), "sid"),
        _finding(file, "self_match", ids.where(own), "id"),
        _finding(file, "wrong_prefix", ids.where(~own & ~known), "id"),
        _finding(file, "missing_s1", need.join(seen, "sid", "left_anti"), "sid"),
        _finding(file, "unknown_s1", seen.join(need, "sid", "left_anti"), "sid"),
    ]
    if targets is not None:
        out.append(_finding(file, "unknown_id", ids.where(known).join(targets.select("id").distinct(), "id", "left_anti"), "id"))
    return reduce(DataFrame.unionByName, out)


def last_lists(rows: DataFrame) -> DataFrame:
    """(sid, ids): of repeated rows the last counts."""
    return rows.where("tabbed").groupBy("sid").agg(F.max_by("ids", "line_number").alias("ids"))


def subset_finding(matches: DataFrame, candidates: DataFrame, file: str) -> DataFrame:
    """Warning: entities with a match that isn't among their candidates."""
    both = last_lists(matches).join(last_lists(candidates).withColumnRenamed("ids", "c"), "sid", "left")
    apart = F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))) > 0
    return _finding(file, "match_not_candidate", both.where(apart), "sid", "warning")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _one(spark: SparkSession, file: str, rule: str, severity: str, *examples: str) -> DataFrame:
    return spark.createDataFrame([(file, rule, severity, 1, list(examples))], SCHEMA)


def _opened(spark: SparkSession, path: str, header: tuple[str, ...]) -> tuple[DataFrame | None, DataFrame | None]:
    """(parsed rows after the header, None), or (None, the finding that stops the file)."""
    name = path.rsplit("/", 1)[-1]
    if not _exists(spark, path):
        return None, _one(spark, name, "file_missing", "error", path)
    try:
        sound = spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    except Exception as e:  # whatever the file system says, it is a finding
        return None, _one(spark, name, "unreadable", "fatal", path, str(e).splitlines()[0][:200])
    if not sound:
        return None, _one(spark, name, "not_utf8", "fatal", path)
    lines = read_lines(spark, path)
    first = lines.where("line_number = 1").first()
    if first is None:
        return None, _one(spark, name, "file_empty", "error", path)
    if "\t" not in first["value"] and "," in first["value"]:
        return None, _one(spark, name, "comma_separated", "error", first["value"])
    found = tuple(c.strip().lower() for c in first["value"].split("\t"))
    if found != header:
        return None, _one(spark, name, "unexpected_header", "error", first["value"])
    return parsed(lines.where("line_number > 1")), None


def validate(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """(file, rule, severity, offenders, examples): all findings over the output files; none for sound ones.

    severity is error, warning, or fatal for a file that can't be read as text.
    """
    source1 = f"{test_dir}/test_source1.tsv"
    if not _exists(spark, source1):
        return _one(spark, "test_source1.tsv", "file_missing", "error", source1)
    required, targets, out = read_ids(spark, source1), None, []
    if check_ids:
        paths = [f"{test_dir}/test_source{i}.tsv" for i in (2, 3)]
        absent = [p for p in paths if not _exists(spark, p)]
        if absent:
            out.append(_one(spark, absent[0].rsplit("/", 1)[-1], "targets_missing", "warning", *absent))
        else:
            targets = read_ids(spark, paths[0]).unionByName(read_ids(spark, paths[1]))
    else:
        out.append(_one(spark, "-", "id_check_off", "warning"))
    rows: dict[tuple[str, ...], DataFrame] = {}
    for path, header in ((matching, MATCHING), (candidate, CANDIDATE)):
        if path is None:
            continue
        if header is CANDIDATE and not _exists(spark, path):
            out.append(_one(spark, path.rsplit("/", 1)[-1], "candidates_missing", "warning", path))
            continue
        found, stopped = _opened(spark, path, header)
        if stopped is not None:
            out.append(stopped)
            continue
        rows[header] = found
        out.append(list_findings(found, path.rsplit("/", 1)[-1], required, targets))
    if len(rows) == 2:
        out.append(subset_finding(rows[MATCHING], rows[CANDIDATE], matching.rsplit("/", 1)[-1]))
    return reduce(DataFrame.unionByName, out)


def summary(spark: SparkSession, path: str, header: tuple[str, ...] = MATCHING) -> dict | None:
    """rows, empty and non-empty lists of a result file; None where it can't be read as one."""
    rows, stopped = _opened(spark, path, header)
    if stopped is not None:
        return None
    listed = rows.where("tabbed")
    return listed.agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.count_if(F.size("ids") > 0).alias("non_empty")).first().asDict()
