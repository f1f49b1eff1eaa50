"""Sinks: single TSV files, JSON and Markdown reports, the append-only log."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def write_tsv(df: DataFrame, path: str, order: str) -> None:
    """One TSV file with a header, sorted, without quoting; an empty string leaves nothing after its tab.

    The sort is distributed; only the writing of the one file is not. It works on any file system Spark writes to.
    """
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    ranged = df.orderBy(order)
    ranged.coalesce(1).sortWithinPartitions(order).write.options(sep="\t", header=True, emptyValue="", nullValue="", quote="").csv(folder)
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(folder)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(source, True)


def write_rows(rows: Sequence[dict], path: str, fallback: Sequence[str]) -> None:
    """A bounded sample as TSV; without a row, a header of the fallback columns."""
    with Path(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else list(fallback), delimiter="\t")
        out.writeheader()
        out.writerows(rows)


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def markdown_table(header: Sequence[str], rows: Sequence[Sequence]) -> str:
    lines = [header, ["---"] * len(header), *rows]
    return "\n".join("| " + " | ".join(f"{x:,}" if isinstance(x, int) else str(x) for x in line) + " |" for line in lines)


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text.rstrip("\n") + "\n", encoding="utf-8")


def append_log(record: dict, path: str) -> None:
    """One line more; the header only in a new file."""
    log = Path(path)
    new = not log.exists()
    with log.open("a", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(record))
        if new:
            out.writeheader()
        out.writerow(record)
