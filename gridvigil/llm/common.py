"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

from gridvigil.session import scratch_path

#: rows turned into Python objects at a time; Arrow batches themselves stay columnar
ROWS = 256


def worker_state() -> dict:
    """What lives as long as the Python process. Functions come with every task anew, and their
    modules' variables with them, so caches that tasks share are kept here."""
    return vars(sys).setdefault("_gridvigil_state", {})


def cache_of(owner: str, clear: Callable[[], None]) -> None:
    """Name the cache that an operator keeps in a Python worker."""
    worker_state().setdefault("caches", {})[owner] = clear


def claim(owner: str) -> None:
    """Empty the other operators' caches, and give their memory back: Spark lends one worker to many stages."""
    state = worker_state()
    if state.get("owner") == owner:
        return
    state["owner"] = owner
    for name, clear in state.get("caches", {}).items():
        if name != owner:
            clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHashes(dict):
    """64-bit hash of each word; emptied when full, for a hash costs little more than a look-up."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


word_hash = WordHashes().__getitem__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame, columns: list[str], function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """``function`` on lists of at most ``ROWS`` values of ``columns``; it returns lists.

    Only ``columns`` leave the JVM, so other columns, whatever their names, play no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = {name: part.column(i).to_pylist() for i, name in enumerate(columns)}
                found = function(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, at most ``rows`` and some ``size`` bytes of text together; a text may be longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, before = 0, 0
    while start < batch.num_rows:
        end = int(np.searchsorted(ends, before + size, side="right"))
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def whole_number_ids(df: DataFrame, column: str) -> None:
    """Refuse ids that are no whole numbers, before any work is done."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")


def map_whole(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``run`` over whole rows that keep their columns; the columns' names may be of any kind."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(named, plain.schema).toDF(*names)


_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder under the checkpoint folder that all executors reach.

    It goes when the driver's JVM ends, or with ``remove_since``.
    """
    _FOLDERS.append(scratch_path(spark, name))
    return _FOLDERS[-1]


def folders_made() -> int:
    """How many shared folders there are so far, for ``remove_since``."""
    return len(_FOLDERS)


def remove_since(spark: SparkSession, number: int) -> None:
    """Delete the shared folders made after ``folders_made`` gave ``number``, but the last one."""
    context = spark.sparkContext
    for folder in _FOLDERS[number:-1]:
        parent = context._jvm.org.apache.hadoop.fs.Path(folder).getParent()
        parent.getFileSystem(context._jsc.hadoopConfiguration()).delete(parent, True)
    del _FOLDERS[number:-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a Parquet table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_blobs(df: DataFrame, column: str, path: str, per_file: int | None, end: str) -> None:
    """Write binary values as files, ``per_file`` values in each, ``end`` behind every value.

    Spark's text sink copies the bytes of a string as they are, so files go wherever Spark
    can write, and a task that is run again replaces its own files.
    """
    text = df.select(df[column].cast("string").alias("value"))
    writer = text.write.option("lineSep", end)
    if per_file is not None:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
