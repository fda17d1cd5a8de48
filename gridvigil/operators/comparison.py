"""Uncertainty of metrics over runs, and tests between detectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import broadcast_if_small, collect_bounded, materialise, settle
from gridvigil.functions.hashing import draw_number, row_digest
from gridvigil.functions.statistics import mcnemar_p, rank_sum_p, wilson_bounds
from gridvigil.operators.ordering import with_position
from gridvigil.operators.sampling import join_strata
from gridvigil.operators.scoring import score_curve

MAX_MODELS = 10_000


# --- aggregates over runs ------------------------------------------------------------------


def long_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per (keys, metric)."""
    wide = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(list(keys), list(names), "metric", "value")


def run_aggregate(metrics: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per metric; a missing value is left out of its metric."""
    rows = long_metrics(metrics, group, names)
    return (
        rows.groupBy(*group, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.count(F.lit(1)).alias("n_runs"),
        )
        .where(F.col("mean").isNotNull())
    )


def seed_aggregate(metrics: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean, range and sample deviation (0 for one seed) per metric."""
    rows = long_metrics(metrics, group, names)
    return rows.groupBy(*group, "metric").agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def rate_intervals(
    counts: DataFrame, run: Sequence[str], normal_label: str = "Normal"
) -> DataFrame:
    """Accuracy, false-alarm and detection rate with Wilson bounds, in long form."""
    normal = F.col("y_true") == normal_label
    alarm = F.col("y_pred") != normal_label
    tally = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0))
    sums = counts.groupBy(*run).agg(
        tally(F.col("y_true") == F.col("y_pred")).alias("hit"),
        F.sum("n").alias("all"),
        tally(normal & alarm).alias("false"),
        tally(normal).alias("normals"),
        tally(~normal & alarm).alias("found"),
        tally(~normal).alias("attacks"),
    )
    line = lambda name, k, n: F.struct(
        F.lit(name).alias("rate"), F.col(k).alias("k"), F.col(n).alias("n")
    )
    rows = sums.select(
        *run,
        F.inline(
            F.array(
                line("accuracy", "hit", "all"),
                line("far", "false", "normals"),
                line("dr", "found", "attacks"),
            )
        ),
    )
    low, high = wilson_bounds(F.col("k"), F.col("n"))
    share = F.col("k") / F.when(F.col("n") > 0, F.col("n"))
    return rows.withColumns({"share": share, "lo": low, "hi": high})


#: groups of more values are resampled by weights
FEW_VALUES = 5000
#: rows whose weights are drawn together, and numbers a task holds before it passes them on
WEIGHT_ROWS = 512
MAX_HELD = 2_000_000


def bootstrap_interval(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order_col: str,
    resamples: int = 5000,
    level: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Mean and percentile interval of the mean for each key.

    In a group of up to ``FEW_VALUES`` values, draw d of resample b picks the value at position
    hash(seed:b:d) mod n. A larger group is resampled where its rows lie: each row counts in
    each resample as often as a Poisson draw of mean 1 from a hash of ``order_col`` says, and
    a task passes on two sums for each group and resample. ``order_col`` is unique in a
    group. Both give the same resamples under any partitioning.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, order_col, F.col(value).cast("double").alias("_x"))
    values = settle(rows)
    sizes = settle(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("mean")))
    few, many = sizes.where(F.col("_n") <= FEW_VALUES), sizes.where(F.col("_n") > FEW_VALUES)
    means = _picked_means(join_strata(values, few.select(*keys), keys), few, keys, order_col, resamples, seed)
    if many.limit(1).count():
        weighted = _weighted_means(values, many, keys, order_col, resamples, seed)
        means = means.unionByName(weighted)
    tail = (1 - level) / 2
    bounds = means.groupBy(*keys).agg(
        F.percentile("_mean", tail).alias("lo"), F.percentile("_mean", 1 - tail).alias("hi")
    )
    return join_strata(sizes.select(*keys, "mean", F.col("_n").alias("n")), bounds, keys)


def _picked_means(
    values: DataFrame, sizes: DataFrame, keys: list[str], order_col: str, resamples: int, seed: int
) -> DataFrame:
    placed = with_position(values, [order_col], keys, out="_at")
    draws = (
        sizes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .repartition(*keys, "_b")
        .withColumn("_d", F.explode(F.expr("sequence(0L, _n - 1)")))
        .withColumn("_at", draw_number(row_digest(seed, "_b", "_d")) % F.col("_n"))
    )
    joined = join_strata(draws, placed.select(*keys, "_at", "_x"), [*keys, "_at"])
    return joined.groupBy(*keys, "_b").agg(F.avg("_x").alias("_mean"))


def poisson_table() -> np.ndarray:
    """Poisson(1) draw of each 16-bit number."""
    share, total, ends = math.exp(-1), 0.0, []
    for n in range(12):
        total += share
        ends.append(total)
        share /= n + 1
    return np.searchsorted(np.array(ends), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def weights_of(hashes: np.ndarray, resamples: int, table: np.ndarray) -> np.ndarray:
    """How often each row (by its hash) counts in each resample; four draws from a 64-bit hash."""
    steps = np.arange(-(-resamples // 4), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = hashes[:, None] + steps[None, :]
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return table[mixed.view(np.uint16)[:, :resamples]]


def _weighted_means(
    values: DataFrame, sizes: DataFrame, keys: list[str], order_col: str, resamples: int, seed: int
) -> DataFrame:
    numbered = materialise(sizes.select(*keys, F.monotonically_increasing_id().alias("_g")))
    rows = join_strata(values, broadcast_if_small(numbered), keys).select(
        "_g", F.xxhash64(F.lit(seed), F.col(order_col)).alias("_h"), "_x"
    )
    table = poisson_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def rows_of() -> pa.RecordBatch:
            kind = pa.list_(pa.float64())
            found = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.int64()),
                    pa.array([list(x[0]) for x in held.values()], kind),
                    pa.array([list(x[1]) for x in held.values()], kind),
                ],
                names=["_g", "_w", "_wx"],
            )
            held.clear()
            return found

        for batch in batches:
            group, hashes, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for g in np.unique(group).tolist():
                own = np.flatnonzero(group == g)
                total = held.setdefault(g, np.zeros((2, resamples)))
                for start in range(0, len(own), WEIGHT_ROWS):
                    some = own[start : start + WEIGHT_ROWS]
                    weights = weights_of(hashes[some].astype(np.int64).view(np.uint64), resamples, table)
                    total[0] += weights.sum(0, dtype=np.int64)
                    total[1] += x[some] @ weights
                if len(held) * 2 * resamples > MAX_HELD:
                    yield rows_of()
        if held:
            yield rows_of()

    sums = rows.mapInArrow(run, "_g long, _w array<double>, _wx array<double>")
    per_resample = sums.select("_g", F.posexplode(F.arrays_zip("_w", "_wx")).alias("_b", "_s"))
    means = per_resample.groupBy("_g", "_b").agg((F.sum("_s._wx") / F.sum("_s._w")).alias("_mean"))
    return means.join(broadcast_if_small(numbered), "_g").select(*keys, "_b", "_mean")


# --- paired detectors -----------------------------------------------------------------------


def paired_predictions(
    df: DataFrame,
    keys: Sequence[str],
    first: str,
    second: str,
    columns: Sequence[str] = ("y_pred",),
    model_col: str = "model",
    y_true: str = "y_true",
) -> DataFrame:
    """Rows both detectors scored, with ``a_…`` and ``b_…`` columns.

    One aggregate by row key does the work of a self join with a single shuffle. The rows
    are moved before they are combined: with two rows per key, combining first saves nothing.
    """

    def side(model: str) -> Column:
        picked = F.struct(*columns)
        return F.max(F.when(F.col(model_col) == model, picked))

    both = (
        df.where(F.col(model_col).isin(first, second))
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.max(y_true).alias("y_true"), side(first).alias("_a"), side(second).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    return both.select(
        *keys,
        "y_true",
        *[F.col(f"_a.{c}").alias(f"a_{c}") for c in columns],
        *[F.col(f"_b.{c}").alias(f"b_{c}") for c in columns],
    )


def paired_counts(pairs: DataFrame, run: Sequence[str]) -> DataFrame:
    """Accuracies, their difference, agreement, and who is right alone (b first, c second)."""
    a_right = F.coalesce(F.col("a_y_pred") == F.col("y_true"), F.lit(False))
    b_right = F.coalesce(F.col("b_y_pred") == F.col("y_true"), F.lit(False))
    share = lambda rule: F.avg(rule.cast("int"))
    return pairs.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n"),
        share(a_right).alias("acc_a"),
        share(b_right).alias("acc_b"),
        (share(a_right) - share(b_right)).alias("delta_acc"),
        share(F.col("a_y_pred").eqNullSafe(F.col("b_y_pred"))).alias("agreement"),
        F.sum((a_right & ~b_right).cast("long")).alias("b"),
        F.sum((b_right & ~a_right).cast("long")).alias("c"),
    )


def mcnemar(pairs: DataFrame, run: Sequence[str]) -> DataFrame:
    return paired_counts(pairs, run).withColumn("p", mcnemar_p(F.col("b"), F.col("c")))


# --- detectors over seeds -------------------------------------------------------------------


def _against_reference(
    df: DataFrame, run: Sequence[str], model_col: str, value: str, reference: str
) -> DataFrame:
    """Rows (run, model, is_model, value): each model's values beside the reference's."""
    names = collect_bounded(df.select(model_col).distinct(), MAX_MODELS)
    if names is None:
        raise ValueError(f"more than {MAX_MODELS} models")
    others = F.array(*[F.lit(r[0]) for r in sorted(names) if r[0] != reference])
    is_model = F.col(model_col) != reference
    compared = F.when(is_model, F.array(model_col)).otherwise(others)
    return df.select(
        *run, F.explode(compared).alias(model_col), is_model.alias("_is_model"), F.col(value)
    )


def rank_sum(
    df: DataFrame, run: Sequence[str], value: str, reference: str, model_col: str = "model"
) -> DataFrame:
    """Mann-Whitney U of every model against ``reference``, two-sided.

    U counts the pairs in which the model's value is the higher one, ties half: the same
    cumulative counts as for AUROC.
    """
    sides = _against_reference(df, run, model_col, value, reference)
    keys = [*run, model_col]
    curve = score_curve(sides, keys, F.col("_is_model"), value)
    tied = (F.col("pos") + F.col("neg")).cast("double")
    sums = curve.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)).alias("u"),
        F.first("n_pos").alias("n_model"),
        F.first("n_neg").alias("n_reference"),
        F.sum(tied * tied * tied - tied).alias("tie_term"),
    )
    both = (F.col("n_model") > 0) & (F.col("n_reference") > 0)
    return sums.where(both).withColumn("p", rank_sum_p("u", "n_model", "n_reference", "tie_term"))


def class_f1_comparison(
    class_scores: DataFrame,
    group: Sequence[str],
    reference: str,
    resamples: int = 5000,
    seed_col: str = "seed",
    model_col: str = "model",
) -> DataFrame:
    """Per model and class: F1 mean and interval over seeds, difference and p to a reference."""
    keys = [*group, "class"]
    f1 = settle(class_scores.where(F.col("support") > 0).select(*keys, model_col, seed_col, "f1"))
    interval = bootstrap_interval(f1, [*keys, model_col], "f1", seed_col, resamples)
    tests = rank_sum(f1, keys, "f1", reference, model_col).select(*keys, model_col, "p")
    base = F.max(F.when(F.col(model_col) == reference, F.col("mean"))).over(
        Window.partitionBy(*keys)
    )
    return interval.withColumn("delta", F.col("mean") - base).join(
        tests, [*keys, model_col], "left"
    )
