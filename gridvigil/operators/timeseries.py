"""Position-based windows over ordered rows.

A series is cut into blocks of consecutive positions. Each block also gets copies of the
``halo`` rows before it, so a window function inside the block sees what it would see in
the whole series, and no task ever sorts a whole series. Halo copies are dropped after.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.operators.ordering import with_position

BLOCK_ROWS = 200_000


def in_blocks(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    halo: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``pos`` in the series, ``_block`` and ``_halo`` (true on copied rows)."""
    block_rows = max(block_rows, halo)
    placed = with_position(df, list(order_cols), list(group_cols))
    own = F.floor(F.col("pos") / block_rows)
    spill = F.col("pos") % block_rows >= block_rows - halo
    blocks = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    copies = placed.withColumn("_block", F.explode(blocks))
    return copies.withColumn("_halo", F.col("_block") != own)


def _framed(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str],
    halo: int,
    block_rows: int,
    columns: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    blocks = in_blocks(df, order_cols, group_cols, halo, block_rows)
    window = Window.partitionBy(*group_cols, "_block").orderBy("pos")
    return blocks.withColumns(columns(window)).where(~F.col("_halo")).drop("_halo", "_block")


def add_deltas(
    df: DataFrame,
    columns: Sequence[str],
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``<c>_delta`` = difference to the row before; 0 on the first row."""

    def deltas(window):
        step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(window), F.lit(0.0))
        return {f"{c}_delta": step(c) for c in columns}

    return _framed(df, order_cols, group_cols, 1, block_rows, deltas).drop("pos")


def add_rolling(
    df: DataFrame,
    columns: Sequence[str],
    order_cols: Sequence[str],
    window_rows: int = 5,
    group_cols: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``<c>_rmean`` and ``<c>_rstd`` (sample deviation, 0 for one row) over the last rows."""

    def rolling(window):
        frame = window.rowsBetween(-(window_rows - 1), 0)
        made = {}
        for c in columns:
            made[f"{c}_rmean"] = F.avg(c).over(frame)
            made[f"{c}_rstd"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        return made

    return _framed(df, order_cols, group_cols, max(1, window_rows - 1), block_rows, rolling).drop(
        "pos"
    )


# --- labels of a window ----------------------------------------------------------------------


def cautious_label(labels: Column, normal_label: str = "Normal") -> Column:
    """First label that is not normal, else the first label."""
    attacks = F.filter(labels, lambda x: x != normal_label)
    return F.coalesce(F.try_element_at(attacks, F.lit(1)), F.try_element_at(labels, F.lit(1)))


def majority_label(labels: Column) -> Column:
    """Most frequent label; equal counts go to the label that sorts first."""
    ballots = F.transform(
        F.array_distinct(labels),
        lambda x: F.struct(
            (-F.size(F.filter(labels, lambda y: y == x))).alias("votes"), x.alias("label")
        ),
    )
    return F.array_min(ballots)["label"]


def sliding_windows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    order_cols: Sequence[str],
    size: int,
    stride: int = 1,
    agg: str = "stats",
    group_cols: Sequence[str] = (),
    normal_label: str = "Normal",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per full window; starts are 0, stride, 2·stride, … in each series.

    ``agg``: ``stats`` (mean, population deviation, min, max, last − first; cautious
    label), ``flatten`` (all steps as ``<c>_t<i>``; majority label) or ``last`` (last row).
    """
    features = list(features)
    group_cols = list(group_cols)
    window_id = F.expr(f"(pos - {size - 1}) div {stride}")
    ends = (F.col("pos") >= size - 1) & ((F.col("pos") - (size - 1)) % stride == 0)
    if agg == "last":
        # The last row of a window needs no neighbours: position, then a filter.
        placed = with_position(df, list(order_cols), group_cols)
        return placed.where(ends).select(
            *group_cols, window_id.alias("window_id"), *features, label
        )
    if agg not in ("stats", "flatten"):
        raise ValueError(f"unknown aggregation {agg}")

    def framed(window):
        frame = window.rowsBetween(-(size - 1), 0)
        made = {"_labels": F.collect_list(label).over(frame)}
        for c in features:
            if agg == "stats":
                made[f"{c}_mean"] = F.avg(c).over(frame)
                made[f"{c}_std"] = F.stddev_pop(c).over(frame)
                made[f"{c}_min"] = F.min(c).over(frame)
                made[f"{c}_max"] = F.max(c).over(frame)
                made[f"{c}_delta"] = F.col(c) - F.lag(c, size - 1).over(window)
            else:
                for i in range(size):
                    back = size - 1 - i
                    made[f"{c}_t{i}"] = F.lag(c, back).over(window) if back else F.col(c)
        return made

    rows = _framed(df, order_cols, group_cols, max(1, size - 1), block_rows, framed).where(ends)
    if agg == "stats":
        made = [f"{c}_{s}" for c in features for s in ("mean", "std", "min", "max", "delta")]
        chosen = cautious_label(F.col("_labels"), normal_label)
    else:
        made = [f"{c}_t{i}" for i in range(size) for c in features]
        chosen = majority_label(F.col("_labels"))
    return rows.select(*group_cols, window_id.alias("window_id"), *made, chosen.alias(label))
