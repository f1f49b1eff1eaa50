"""Sources: strict TSV tables, result files, raw lines, reports, archives."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


class SchemaError(ValueError):
    """A file isn't what its format says."""


def session(name: str = "concord", master: str | None = None, memory: str = "6g", **options: str) -> SparkSession:
    """A session with adaptive execution; master only where nothing else sets it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
    for key, value in (({"spark.master": master} if master else {}) | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as strings, empty fields null. Raises SchemaError on another header or on bytes that aren't UTF-8, and
    fails on rows with too few or too many fields when read."""
    lines = spark.read.text(path)
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        raise SchemaError(f"{path} isn't UTF-8")
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    found = tuple(reader.option("inferSchema", False).csv(path).columns)
    if found != tuple(columns):
        raise SchemaError(f"unexpected schema in {path}: {list(found)}")
    return reader.schema(", ".join(f"{c} string" for c in columns)).csv(path)


def table_once(df_of, spark: SparkSession, name: str) -> DataFrame:
    """The saved table of this name; made with df_of() only where there is none."""
    if not spark.catalog.tableExists(name):
        df_of().write.saveAsTable(name)
    return spark.table(name)


def links_of(truth: DataFrame, sid: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(sid, tid): one row per listed id; empty tokens stay, null lists have no row."""
    return truth.where(F.col(ids).isNotNull()).select(F.col(sid).alias("sid"), F.explode(F.split(ids, ",")).alias("tid"))


def read_dataset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six sources and the truth of a dataset folder, by name, and truth_links."""
    names = [f"{split}_source{i}" for split in ("train", "test") for i in (1, 2, 3)]
    out = {n: read_tsv(spark, f"{root}/dataset/{n.partition('_')[0]}/{n}.tsv", SOURCE_COLUMNS) for n in names}
    out["train_ground_truth"] = read_tsv(spark, f"{root}/dataset/train/train_ground_truth.tsv", TRUTH_COLUMNS)
    return out | {"truth_links": links_of(out["train_ground_truth"])}


def rows(df: DataFrame) -> list[dict]:
    """A small result as dicts."""
    return [r.asDict() for r in df.collect()]


def describe(df: DataFrame) -> list[dict]:
    return [{"column_name": f.name, "column_type": f.dataType.simpleString(), "null": "YES" if f.nullable else "NO"} for f in df.schema]


def id_list(ids: Column) -> Column:
    """The ids of a comma list; null and empty: none."""
    return F.when(F.coalesce(ids, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ","))


def read_results(spark: SparkSession, path: str, column: str = "matched_entity_ids") -> DataFrame:
    """(sid, ids array) of a result file. Raises SchemaError on another header, a repeated sid, or an id listed twice."""
    raw = read_tsv(spark, path, ("source1_entity_id", column)).select(F.coalesce("source1_entity_id", F.lit("")).alias("sid"), id_list(F.col(column)).alias("ids"))
    bad = raw.groupBy("sid").agg(F.count("*").alias("n"), F.max((F.size("ids") != F.size(F.array_distinct("ids"))).cast("int")).alias("twice")).where("n > 1 or twice = 1").limit(1).collect()
    if bad:
        raise SchemaError(f"duplicate row or ids: {bad[0]['sid']}")
    return raw


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value) of a text file as it is, from 1. Lines are numbered within the one file read."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return numbered(lines, ["at"], "line_number").select((F.col("line_number") + 1).alias("line_number"), "value")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): distinct first fields after the header, trimmed; blank lines are left out."""
    lines = read_lines(spark, path).where("line_number > 1")
    return lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").select(F.regexp_replace(F.substring_index("value", "\t", 1), r"^\s+|\s+$", "").alias("id")).distinct()


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def extract(archive: str, target: str, prefix: str = "") -> list[dict]:
    """Extracts members below prefix and returns their manifest (path, bytes, CRC-32).

    Hidden files and resource forks are left out; a member that would leave the target, or overwrite a file, is an error.
    """
    out, root = [], Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for member in z.infolist():
            parts = PurePosixPath(member.filename).parts
            if member.is_dir() or not member.filename.startswith(prefix) or any(p.startswith(".") and p != ".." or p == "__MACOSX" for p in parts):
                continue
            path = (root / member.filename).resolve()
            if not path.is_relative_to(root):
                raise SchemaError(f"{member.filename} leaves the target folder")
            if path.exists():
                raise FileExistsError(path)
            path.parent.mkdir(parents=True, exist_ok=True)
            with z.open(member) as source, path.open("wb") as sink:
                while block := source.read(1 << 20):
                    sink.write(block)
            out.append({"path": member.filename, "bytes": member.file_size, "crc32": f"{member.CRC:08x}"})
    return out
