"""Result tables: sinks and the scan over many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvigil.operators.sampling import join_strata
from gridvigil.session import scratch_path  # noqa: F401


def save_processed(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", "true").csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def save_results(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "experiment")) -> None:
    """One CSV folder per data set and experiment; readers prune by folder."""
    df.write.mode("overwrite").partitionBy(*by).option("header", "true").csv(path)


def save_metrics_json(df: DataFrame, path: str, drop: Sequence[str] = ("runs",)) -> None:
    """Metric rows as JSON lines without the per-run detail."""
    df.drop(*drop).write.mode("overwrite").json(path)


#: rows of a run that one task writes
ROWS_A_WRITER = 1_000_000


def save_predictions(df: DataFrame, path: str, by: Sequence[str] = ("dataset", "model", "seed")) -> None:
    """Raw predictions for later analysis, partitioned by run.

    Rows are gathered per run and salted by the run's size, so a run of any size is written
    in files of some ``ROWS_A_WRITER`` rows.
    """
    writers = (F.count(F.lit(1)) / ROWS_A_WRITER).cast("long") + 1
    sized = join_strata(df, df.groupBy(*by).agg(writers.alias("_writers")), by, "left")
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_writers")))
    dealt = salted.repartition(*by, "_salt").select(*df.columns)
    dealt.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_runs(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str,
    dataset: str = r"_([a-z0-9]+)\.csv$",
    mode: str = r"(?i)(binary|multiclass)",
) -> DataFrame:
    """Result CSVs of many runs; data set and mode come from the path.

    Missing or unreadable files are skipped; no row is: a value that does not fit is null.
    """
    rows = (
        spark.read.option("header", "true")
        .option("enforceSchema", "false")
        .option("mode", "PERMISSIVE")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .schema(schema)
        .csv([paths] if isinstance(paths, str) else list(paths))
    )
    path = F.col("_metadata.file_path")
    return rows.withColumns(
        {
            "dataset": F.regexp_extract(path, dataset, 1),
            "mode": F.lower(F.regexp_extract(path, mode, 1)),
        }
    )
