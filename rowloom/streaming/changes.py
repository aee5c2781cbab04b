"""Keeping a stored view current from a stream of change sets.

Each micro-batch is one change set (see ``operators.changes``). It is applied to the last stored
version, and the result is written as the next one, named after the batch; a batch that is run
again after a failure starts from the version before it and writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowloom.operators.changes import loadmods
from rowloom.plans.view import View
from rowloom.sources.tables import load, save


def version_path(root: str, batch: int) -> str:
    return f"{root}/v{batch:012d}"


def start(base: View, root: str) -> None:
    """Stores the view as the version before the first batch."""
    save(base.numbered(), version_path(root, 0))


def follow(changes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a stream of change sets to the view stored under root."""

    def apply(batch: DataFrame, number: int) -> None:
        before = load(batch.sparkSession, version_path(root, number))
        save(loadmods(before, batch), version_path(root, number + 1))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def version(spark: SparkSession, root: str, batches: int) -> View:
    """The view after so many batches."""
    return load(spark, version_path(root, batches))
