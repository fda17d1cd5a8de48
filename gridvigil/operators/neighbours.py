"""Exact k nearest neighbours between two tables, without comparing all pairs in one place.

Points are assigned to the nearest of a few pivots (a cell). For each query the cells'
distance ranges give an upper bound on its k-th distance, and the triangle inequality
rules out every cell that cannot hold a closer point. What is left is joined by cell.
Large cells are split into blocks of bounded size on both sides, each pair of blocks
yields at most k candidates per query, and the candidates are merged per query. Blocks grow
with the tables up to a bound, so that few copies of the vectors are shuffled.

A pair of blocks is compared by a matrix product; only the pairs that its rounding errors
leave in doubt are measured component by component, and these distances decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import collect_bounded, local_table
from gridvigil.operators.sampling import uniform_sample

#: least and most rows of a block of points and of queries, and how many blocks a side should have
POINT_BLOCKS = (4096, 32_768)
QUERY_BLOCKS = (1024, 16_384)
WANTED_BLOCKS = 16
#: values of the matrix products held at once, and components of the pairs measured at once
TILE = 1 << 22
MEASURED = 1 << 22
MAX_PIVOTS = 512
MAX_CELLS = 200_000
_SLACK = 1e-9


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        total += step * step
    return np.sqrt(total)


def _measured(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the pairs (rows, cols), by the steps of ``_distances``."""
    dist = np.empty(len(rows))
    step = max(1, MEASURED // max(1, a.shape[1]))
    for i in range(0, len(rows), step):
        gap = a[rows[i : i + step]] - b[cols[i : i + step]]
        gap *= gap
        total = np.zeros(len(gap))
        for j in range(gap.shape[1]):
            total += gap[:, j]
        dist[i : i + step] = np.sqrt(total)
    return dist


def _near_pairs(
    a: np.ndarray, b: np.ndarray, k: int, same: Callable[[int, int], tuple[np.ndarray, np.ndarray]] | None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, rows, columns): pairs that may be among the k nearest of a row of ``a``.

    ``same`` gives the pairs of some rows that do not count. |b|^2 - 2ab orders the columns of a
    row like their distances; ``slack`` exceeds all rounding errors in it and in the distances.
    """
    width = a.shape[1]
    size_a, size_b = np.sqrt((a * a).sum(1)), (b * b).sum(1)
    slack = 8 * (width + 8) * np.finfo(float).eps * (size_a + np.sqrt(size_b.max())) ** 2
    product = bool(np.isfinite(slack).all())
    # The k-th smallest of the least values of so many groups of columns bounds the k-th smallest value.
    groups = min(len(b), max(64, 4 * k))
    full = -(-len(b) // groups) * groups
    other = np.zeros((width + 1, full))
    other[:width, : len(b)], other[width], other[width, : len(b)] = b.T, np.inf, size_b
    step = max(1, TILE // full)
    for i in range(0, len(a), step):
        some = a[i : i + step]
        if product:
            value = np.hstack([-2 * some, np.ones((len(some), 1))]) @ other
        else:  # too large for products
            value = np.full((len(some), full), np.inf)
            value[:, : len(b)] = np.nan_to_num(_distances(some, b), nan=np.inf)
        if same is not None:
            value[same(i, i + len(some))] = np.inf
        least = value if full == groups else value.reshape(len(some), -1, groups).min(axis=1)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if groups >= k else np.full(len(some), np.inf)
        if product:
            bound = bound + slack[i : i + step]
        bound = np.minimum(bound, np.finfo(float).max)  # what does not count is infinite
        rows, cols = np.nonzero(value <= bound[:, None])
        yield i, i + len(some), rows + i, cols


def _smallest(
    a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, same: Callable | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and distances of the k smallest per row; equal values by lower id."""
    found = []
    for first, last, rows, cols in _near_pairs(a, b, k, same):
        dist = _measured(a, b, rows, cols)
        order = np.lexsort((ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        starts = np.searchsorted(rows, np.arange(first, last))
        keep = (np.arange(len(rows)) - starts[rows - first] < k) & np.isfinite(dist)
        found.append((rows[keep], cols[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs_of_same_id(asking: pd.Series, offered: pd.Series) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """Pairs of equal ids by row numbers of ``asking``: (row in the slice, column)."""
    codes, _ = pd.factorize(pd.concat([asking, offered], ignore_index=True))
    own, others = codes[: len(asking)], codes[len(asking) :]
    order = np.argsort(others, kind="stable")
    ranked = others[order]
    low, high = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
    high = np.where(own < 0, low, high)  # a missing id equals no other

    def pairs(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        n = high[first:last] - low[first:last]
        rows = np.repeat(np.arange(last - first), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[first:last], n)
        return rows, order[place]

    return pairs


@dataclass(frozen=True)
class _Cells:
    """Distance range and k nearest distances of every (group, pivot) cell."""

    pivots: np.ndarray
    groups: np.ndarray
    pivot_of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray

    def visits(self, vectors: np.ndarray, groups: np.ndarray, k: int) -> list[list[int]]:
        """Numbers of the cells that may hold one of the k nearest points, per query."""
        to_pivot = _distances(vectors, self.pivots)
        found: list[list[int]] = [[] for _ in range(len(vectors))]
        for group in set(groups):
            own = np.nonzero(self.groups == group)[0]
            rows = np.nonzero(groups == group)[0]
            if not len(own):
                continue
            step = max(1, TILE // (len(own) * self.near.shape[1]))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                d = to_pivot[some][:, self.pivot_of[own]]
                bounds = (d[:, :, None] + self.near[own]).reshape(len(some), -1)
                last = min(k, bounds.shape[1]) - 1
                reach = np.partition(bounds, last, axis=1)[:, last, None]
                least = np.maximum(0.0, np.maximum(d - self.high[own], self.low[own] - d))
                for row, near in zip(some, least <= reach * (1 + _SLACK) + _SLACK):
                    found[row] = own[near].tolist()
        return found


def _block(n: int, given: int | None, sizes: tuple[int, int]) -> int:
    return given or min(max(sizes[0], -(-n // WANTED_BLOCKS)), sizes[1])


def nearest(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    point_id: str = "id",
    query_id: str = "id",
    vector: str = "vector",
    group: str | None = None,
    skip_self: bool = False,
    keep: Sequence[str] = (),
    point_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """(query_id, neighbour, distance, rank, kept point columns), rank 1 = nearest.

    With ``group`` only points of the query's own group count. ``skip_self`` leaves out
    the point with the query's id. The block sizes follow the tables' sizes unless given.
    """
    wanted = k + 1 if skip_self else k
    spark = points.sparkSession
    group_of = F.col(group).cast("string") if group else F.lit("")
    base = points.select(
        F.col(point_id).alias("_pid"),
        F.col(vector).cast("array<double>").alias("_vec"),
        group_of.alias("_group"),
        *keep,
    )
    n = base.count()
    id_type = base.schema["_pid"].dataType.simpleString()
    qid_type = queries.schema[query_id].dataType.simpleString()
    kept_types = [f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep]
    out_schema = ", ".join(
        [f"_qid {qid_type}", f"_pid {id_type}", "_dist double", *kept_types]
    )
    if n == 0:
        empty = f"{query_id} {qid_type}, neighbour {id_type}, distance double, rank int"
        return spark.createDataFrame([], ", ".join([empty, *kept_types]))
    point_block = _block(n, point_block, POINT_BLOCKS)
    pivot_count = max(1, min(MAX_PIVOTS, -(-n // point_block)))
    pivots = np.array(
        [list(r[0]) for r in uniform_sample(base, pivot_count, ["_pid"]).select("_vec").collect()],
        dtype=np.float64,
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                dist = _distances(_stack(batch["_vec"]), pivots)
                batch["_pivot"] = dist.argmin(axis=1).astype("int32")
                batch["_far"] = dist.min(axis=1)
                yield batch

    schema = ", ".join(
        [f"_pid {id_type}", "_vec array<double>", "_group string", *kept_types]
        + ["_pivot int", "_far double"]
    )
    assigned = base.mapInPandas(assign, schema)

    # Statistics per cell: MAX_PIVOTS cells per group, k distances each. A task sends a few
    # numbers per cell and batch, so the points are not shuffled for them.
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            dist = _distances(_stack(batch["_vec"]), pivots)
            found = pd.DataFrame(
                {"_group": batch["_group"], "_pivot": dist.argmin(axis=1).astype("int32"), "_far": dist.min(axis=1)}
            )
            grouped = found.groupby(["_group", "_pivot"], sort=False)["_far"]
            rows = [
                (g, p, len(v), v.min(), v.max(), np.sort(v.to_numpy())[:wanted].tolist())
                for (g, p), v in grouped
            ]
            yield pd.DataFrame(rows, columns=["_group", "_pivot", "_n", "_low", "_high", "_near"])

    summary = base.select("_vec", "_group").mapInPandas(
        summarise,
        "_group string, _pivot int, _n long, _low double, _high double, _near array<double>",
    )
    summary = summary.persist()
    place = Window.partitionBy("_group", "_pivot").orderBy("_far")
    close = (
        summary.select("_group", "_pivot", F.explode("_near").alias("_far"))
        .withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") <= wanted)
    )
    ranges = summary.groupBy("_group", "_pivot").agg(
        F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    nearest_far = close.groupBy("_group", "_pivot").agg(
        F.sort_array(F.collect_list("_far")).alias("_near")
    )
    stats = collect_bounded(ranges.join(nearest_far, ["_group", "_pivot"]), MAX_CELLS)
    summary.unpersist()
    if stats is None:
        raise ValueError(f"more than {MAX_CELLS} cells: too many groups")
    stats.sort(key=lambda r: (r["_group"], r["_pivot"]))
    near = np.full((len(stats), wanted), np.inf)
    for i, r in enumerate(stats):
        near[i, : len(r["_near"])] = r["_near"]
    cells = _Cells(
        pivots,
        np.array([r["_group"] for r in stats], dtype=object),
        np.array([r["_pivot"] for r in stats], dtype=int),
        np.array([r["_low"] for r in stats]),
        np.array([r["_high"] for r in stats]),
        near,
    )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["_cells"] = cells.visits(_stack(batch["_vec"]), batch["_group"].to_numpy(), wanted)
                yield batch

    asked = queries.select(
        F.col(query_id).alias("_qid"),
        F.col(vector).cast("array<double>").alias("_vec"),
        group_of.alias("_group"),
    )
    routed = asked.mapInPandas(
        route, f"_qid {qid_type}, _vec array<double>, _group string, _cells array<int>"
    ).select("_qid", "_vec", F.explode("_cells").alias("_cell"))

    numbered = local_table(
        spark,
        [(r["_group"], r["_pivot"], i, -(-r["_n"] // point_block)) for i, r in enumerate(stats)],
        "_group string, _pivot int, _cell int, _parts long",
    )
    asked_sizes = dict(routed.groupBy("_cell").agg(F.count(F.lit(1))).collect())
    query_block = _block(max(asked_sizes.values(), default=0), query_block, QUERY_BLOCKS)
    chunks = {cell: -(-size // query_block) for cell, size in asked_sizes.items()}
    plan = local_table(
        spark,
        [(i, -(-r["_n"] // point_block), chunks[i]) for i, r in enumerate(stats) if i in chunks],
        "_cell int, _parts long, _chunks long",
    )
    slot = lambda key, count: F.pmod(F.xxhash64(key), F.col(count))
    left = (
        routed.join(plan, "_cell")
        .withColumn("_chunk", slot("_qid", "_chunks"))
        .withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)")))
        .select("_cell", "_chunk", "_part", "_qid", "_vec")
    )
    right = (
        assigned.join(numbered.drop("_parts"), ["_group", "_pivot"])
        .join(plan, "_cell")
        .withColumn("_part", slot("_pid", "_parts"))
        .withColumn("_chunk", F.explode(F.expr("sequence(0L, _chunks - 1)")))
        .select("_cell", "_chunk", "_part", "_pid", "_vec", *keep)
    )
    names = ["_qid", "_pid", "_dist", *keep]

    def vectors_of(table: pa.Table) -> np.ndarray:
        column = table.column("_vec").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)

    def finite(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """Rows with a vector of numbers; others have no distance to any row."""
        if not table.num_rows:
            return table, np.empty((0, 0))
        vectors = vectors_of(table)
        good = np.isfinite(vectors).all(axis=1)
        return table.filter(pa.array(good)), vectors[good]

    def compare(asking: pa.Table, offered: pa.Table) -> pa.Table:
        (asking, a), (offered, b) = finite(asking), finite(offered)
        rows, cols, dist = np.empty(0, int), np.empty(0, int), np.empty(0)
        if len(a) and len(b):
            qid, pid = asking.column("_qid").to_pandas(), offered.column("_pid").to_pandas()
            same = _pairs_of_same_id(qid, pid) if skip_self else None
            rows, cols, dist = _smallest(a, b, pid.to_numpy(), k, same)
        near = offered.take(pa.array(cols))
        return pa.table(
            [asking.column("_qid").take(pa.array(rows)), near.column("_pid"), pa.array(dist), *[near.column(c) for c in keep]],
            names=names,
        )

    keys = ["_cell", "_part", "_chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, out_schema)
    order = Window.partitionBy("_qid").orderBy("_dist", "_pid")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            F.col("_qid").alias(query_id),
            F.col("_pid").alias("neighbour"),
            F.col("_dist").alias("distance"),
            "rank",
            *keep,
        )
    )


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    label: str,
    k: int = 8,
    id_col: str = "id",
    vector: str = "vector",
) -> DataFrame:
    """(id, y_pred, votes): majority of the k nearest training rows, ties to the lower label."""
    found = nearest(train, test, k, id_col, id_col, vector, keep=[label])
    votes = found.groupBy(id_col, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), F.col(label)))
    return (
        votes.groupBy(id_col)
        .agg(best.alias("_best"))
        .select(id_col, F.col(f"_best.{label}").alias("y_pred"), F.col("_best.votes").alias("votes"))
    )
