"""Size-checked small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridvigil.session import ensure_checkpoint_dir


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row] | None:
    """Rows of ``df`` when there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` as a broadcast local table if its row count passes the check.

    The check runs ``df`` once; beyond the bound the frame comes back unhinted, so the
    join shuffles and adaptive execution handles skew.
    """
    rows = collect_bounded(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def settle(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` computed once into a local table if it is small, else ``df`` itself."""
    rows = collect_bounded(df, max_rows)
    return df if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder.

    For a costly result that several jobs read; it survives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Small table made on the driver, marked for broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))
