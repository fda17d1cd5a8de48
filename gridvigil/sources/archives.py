"""CSV members inside zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lines handed to Spark at a time
_LINES = 50_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of zip files; the file source limits one file to 2 GB."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(
        "path", "content"
    )


def member_lines(archives: DataFrame, member: str) -> DataFrame:
    """(archive, member, line_no, line) of the named member of every archive.

    The exact name is looked for first, then the same base name in any folder. Archives
    without it give no rows. A zip is opened by the task that holds it and streamed out
    in batches; parsing the lines is left to Spark (``from_csv``).
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = archive.namelist()
                base = member.rsplit("/", 1)[-1]
                same = [n for n in names if n == member] or sorted(
                    n for n in names if n.rsplit("/", 1)[-1] == base
                )
                if not same:
                    continue
                lines, number = [], 0
                with archive.open(same[0]) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", errors="replace"):
                        lines.append((path, same[0], number, line.rstrip("\r\n")))
                        number += 1
                        if len(lines) == _LINES:
                            yield pd.DataFrame(lines, columns=columns)
                            lines = []
                if lines:
                    yield pd.DataFrame(lines, columns=columns)

    columns = ["archive", "member", "line_no", "line"]
    return archives.select("path", "content").mapInPandas(
        unpack, "archive string, member string, line_no long, line string"
    )


def csv_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Parse the lines after each header row."""
    return (
        lines.where(F.col("line_no") > 0)
        .withColumn("_row", F.from_csv("line", schema))
        .select("archive", "member", "line_no", "_row.*")
    )
