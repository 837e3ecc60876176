"""Joins with a small side: statistics of series, sizes, short lists. It is sent to all tasks only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import shared_folder

#: Rows that may be sent to all tasks. A row of statistics has a few numbers, so this is some MB at most.
MOST_ROWS = 100_000


def kept(table: DataFrame, name: str = "kept") -> DataFrame:
    """table written to the shared folder and read again: what it took to make it is done once, and survives the loss of executors."""
    path = shared_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def join_small(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = MOST_ROWS) -> DataFrame:
    """rows joined with small, which is made once and counted: up to most rows it is broadcast, so rows aren't shuffled; above, both sides are.

    Statistics of one long series so meet its frames where they are, and a table of very many series is never sent whole.
    """
    held = kept(small, "small")
    return rows.join(F.broadcast(held) if held.count() <= most else held, on, how)
