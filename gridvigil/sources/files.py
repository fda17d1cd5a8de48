"""Finding and reading delimited files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridvigil.functions.bounded import collect_bounded

MAX_FILES = 1_000_000
#: bytes read at a time for a first line, most of them, and files looked at together
PROBE = 1 << 16
MAX_HEADER = 1 << 24
PROBES = 16
# --- fixed values: folders and files left out ---
SKIPPED = r"(?i)(_macosx|haiend|hai-end)"


def find_files(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    skip: str = SKIPPED,
    preferred: Sequence[str] = (),
) -> list[str]:
    """Sorted paths: files right in ``folder``, else in its sub-folders.

    ``preferred`` names version folders (part of the folder name, "_" read as "-"); the
    first one present wins, and all files below it count. Lists through the file source,
    without reading any content.
    """

    def listed(recursive: bool) -> list[str]:
        found = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower())
            .load(folder)
            .select("path")
            .where(~F.col("path").rlike(skip))
        )
        rows = collect_bounded(found, MAX_FILES)
        if rows is None:
            raise ValueError(f"more than {MAX_FILES} files in {folder}")
        return sorted(r[0] for r in rows)

    paths = [] if preferred else listed(False)
    paths = paths or listed(True)
    top = folder.rstrip("/").rsplit("/", 1)[-1]
    for version in preferred:

        def in_version(path: str) -> bool:
            parents = path.partition(f"/{top}/")[2].split("/")[:-1]
            return any(version in p.lower().replace("_", "-") for p in parents[:1])

        chosen = [p for p in paths if in_version(p)]
        if chosen:
            paths = chosen
            break
    if not paths:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return paths


def _first_line(spark: SparkSession, path: str) -> bytes | None:
    """Bytes of the first line, read from the start of the file in steps of ``PROBE``; None if empty."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration()
    stream = hadoop_path.getFileSystem(conf).open(hadoop_path)
    try:
        codec = context._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hadoop_path)
        source = codec.createInputStream(stream) if codec is not None else stream
        held = b""
        while not (ends := re.search(rb"[\r\n]", held)):
            more = bytes(source.readNBytes(PROBE))
            held += more
            if len(more) < PROBE:
                break
            if len(held) > MAX_HEADER:
                raise ValueError(f"{path} has no line end in its first {MAX_HEADER} bytes")
        ends = re.search(rb"[\r\n]", held)
        line = held[: ends.start()] if ends else held
        return line.removeprefix(b"\xef\xbb\xbf") if held else None
    finally:
        stream.close()


def header_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, bytes]:
    """First line of every file that is not empty; no more than the file's start is read."""
    with ThreadPoolExecutor(PROBES) as pool:
        lines = pool.map(lambda p: _first_line(spark, p), paths)
        return {p: line for p, line in zip(paths, lines, strict=True) if line is not None}


def not_utf8(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """The files with a line that is not valid UTF-8, found by one scan; lines stay where they are."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    bad = lines.where(~F.is_valid_utf8("value")).select("path").distinct()
    # names come back as the file source writes them
    rows = collect_bounded(bad, MAX_FILES)
    return {_plain(r["path"]) for r in rows or []}


def _plain(path: str) -> str:
    """A path without the escapes and the empty authority of a URI."""
    return re.sub("^file:/+", "/", unquote(path))


def read_delimited(
    spark: SparkSession,
    paths: Sequence[str],
    separator: str | None = None,
    encoding: str | None = None,
    decimal_comma: bool | None = None,
    source_column: str = "_source_file",
) -> DataFrame:
    """All files as one text table, united by stripped column name.

    Unless given, the separator is found from a file's first line, semicolons if they give more
    than two columns, and the encoding from all its lines: ISO-8859-1 if one is not valid
    UTF-8. In semicolon files a decimal comma becomes a point. Files with the same header are
    one scan; empty files give nothing.
    """
    lines = header_lines(spark, paths)
    other = not_utf8(spark, list(lines)) if lines and encoding is None else set()
    groups: dict[tuple, list[str]] = {}
    for path, line in lines.items():
        charset = encoding or ("ISO-8859-1" if _plain(path) in other else "UTF-8")
        sep = separator or (";" if line.count(b";") >= 2 else ",")
        groups.setdefault((sep, charset, line), []).append(path)
    if not groups:
        raise ValueError("all files are empty")
    parts = []
    for (sep, charset, line), members in sorted(groups.items(), key=lambda g: min(g[1])):
        reader = spark.read.option("sep", sep).option("encoding", charset).option("header", "true")
        names = reader.csv(sorted(members)[:1]).columns
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in names])
        part = reader.option("enforceSchema", "true").schema(schema).csv(sorted(members))
        comma = decimal_comma if decimal_comma is not None else sep == ";"
        if comma:
            number = r"^\s*-?\d*,\d+([eE][-+]?\d+)?\s*$"
            part = part.withColumns(
                {
                    n: F.when(F.col(f"`{n}`").rlike(number), F.replace(F.col(f"`{n}`"), F.lit(","), F.lit(".")))
                    .otherwise(F.col(f"`{n}`"))
                    for n in part.columns
                }
            )
        parts.append(part.withColumn(source_column, F.col("_metadata.file_name")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def densest_files(df: DataFrame, file_col: str, label: str) -> DataFrame:
    """Rows of the best files: the longest file with two or more classes, else the longest
    file of each (most frequent) class."""
    counts = df.groupBy(file_col, label).agg(F.count(F.lit(1)).alias("n"))
    # Aggregates over one row per (file, class); ties go to the lower name.
    files = counts.groupBy(file_col).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("main"),
    )
    longest = F.min_by(file_col, F.struct(-F.col("rows"), F.col(file_col)))
    mixed = files.where("classes >= 2").agg(longest.alias(file_col)).first()[0]
    if mixed is not None:
        return df.where(F.col(file_col) == mixed)
    chosen = files.groupBy("main").agg(longest.alias("_file")).select(F.col("_file").alias(file_col))
    return df.join(chosen, file_col, "left_semi")
