"""Cut a plan by writing its rows to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.session import small_batches, work_folder


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written as Parquet and read again.

    Survives lost executors, is computed once however often it is read, and tells Spark the
    real size, by which joins are then planned.
    """
    folder = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


#: Rows of a few numbers each that are sent to every executor at most.
SENT_ROWS = 500_000


def sent_if_few(rows: DataFrame) -> DataFrame:
    """Stored rows of a few numbers, to be broadcast if their count allows; else Spark shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows
