"""Cutting lineage in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to spark.checkpoint.dir, so that later readers and retried tasks see the same rows.

    A folder of its own is made only where that setting is unset and Spark runs in one process, as in tests.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rowloom-"))
    return df.checkpoint()
