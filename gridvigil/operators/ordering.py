"""Positions in a sort order without a single-task sort.

The sort key is cut into ranges at approximate quantiles. Every quantile value gets a
range of its own, so a value that holds a large share of the rows is alone in its range
and can be cut again by the next sort column. A row's position is its rank inside the
range plus the number of rows in earlier ranges.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridvigil.functions.bounded import broadcast_if_small, materialise


def numeric_key(df: DataFrame, name: str) -> Column:
    """Order-preserving double for a numeric, date or timestamp column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"cannot range-partition by {name}: {kind.simpleString()}")


def range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_sort_range(df: DataFrame, name: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add ``out`` (int), growing with column ``name``; odd ids hold one key value each.

    Rows without a key come first, in range -1.
    """
    ranges = ranges or range_count(df)
    keyed = df.withColumn("_sort_key", numeric_key(df, name))
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(1000, 4 * ranges)
    found = keyed.agg(F.percentile_approx("_sort_key", shares, accuracy)).first()[0]
    edges = sorted(set(found or []))
    splits = [-math.inf]
    for edge in edges:
        splits += [edge, math.nextafter(edge, math.inf)]
    splits = sorted(set(splits)) + [math.inf]
    if len(splits) == 2:
        return keyed.withColumn(out, F.lit(0)).drop("_sort_key")
    bucketizer = Bucketizer(
        splits=splits, inputCol="_sort_key", outputCol="_sort_range", handleInvalid="keep"
    )
    return (
        bucketizer.transform(keyed)
        .withColumn(out, F.coalesce(F.col("_sort_range").cast("int"), F.lit(-1)))
        .drop("_sort_key", "_sort_range")
    )


def with_position(
    df: DataFrame,
    order_cols: list[str],
    group_cols: list[str] = (),
    out: str = "pos",
    ranges: int | None = None,
) -> DataFrame:
    """0-based position by ``order_cols``, within each group if ``group_cols`` is given.

    The order columns together must be unique in a group. They may be of any type that
    sorts; nulls come first.
    """
    group_cols = list(group_cols)
    if not all(_numeric(df, name) for name in order_cols[:2]):
        return _position_by_tuples(df, list(order_cols), group_cols, out, ranges)
    ranged = with_sort_range(df, order_cols[0], "_r1", ranges)
    if len(order_cols) > 1:
        ranged = with_sort_range(ranged, order_cols[1], "_r2", ranges)
        ranged = ranged.withColumn("_r2", F.when(F.col("_r1") % 2 != 0, F.col("_r2")).otherwise(0))
    else:
        ranged = ranged.withColumn("_r2", F.lit(0))
    # As a struct, a missing group value equals itself, so its rows survive the join.
    ranged = ranged.withColumn("_group", F.struct(*group_cols) if group_cols else F.lit(0))
    place = ["_group", "_r1", "_r2"]
    sizes = ranged.groupBy(*place).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy("_group")
        .orderBy("_r1", "_r2")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *place, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    if not group_cols:
        offsets = broadcast_if_small(offsets)
    inside = Window.partitionBy(*place).orderBy(*order_cols)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, place)
        .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop(*place, "_offset", "_rank")
    )


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType | T.TimestampType | T.DateType | T.NumericType)


def _position_by_tuples(
    df: DataFrame, order_cols: list[str], group_cols: list[str], out: str, ranges: int | None
) -> DataFrame:
    """Positions for text and other keys, by ranges of whole tuples.

    Spark samples tuples of all order columns as splitters, so rows that share a hot first
    column, or a long common prefix, are cut by what follows. The ranges are written once, so
    their numbers stand when a task is run again.
    """
    columns = [*group_cols, *order_cols]
    parts = df.repartitionByRange(ranges or range_count(df), *columns).withColumn("_part", F.spark_partition_id())
    ranged = materialise(parts).withColumn("_group", F.struct(*group_cols) if group_cols else F.lit(0))
    sizes = ranged.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order_cols))
    ranked = ranged.withColumn("_rank", rank)
    return (
        ranked.join(broadcast_if_small(offsets), ["_group", "_part"])
        .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_group", "_part", "_offset", "_rank")
    )


def class_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code): every class with its 0-based place in sorted order, nulls left out.

    A table of one row per class, however many there are; join it to encode or decode.
    """
    classes = df.where(F.col(label).isNotNull()).select(label).distinct()
    # ranges of the sort order, written once so that their numbers stand
    ranged = materialise(classes.repartitionByRange(label).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(label)) - 1
    ranked = ranged.withColumn("_place", place).join(offsets, "_part")
    return ranked.select(label, (F.col("_offset") + F.col("_place")).cast("int").alias("code"))
