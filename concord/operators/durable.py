"""Reliable cuts of lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir; in a temporary folder only in local mode, where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="concord-"))
    return df.checkpoint(eager=True)
