"""Report tables over result rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import collect_bounded, materialise
from gridvigil.operators.ordering import with_sort_range
from gridvigil.operators.sampling import join_strata

#: rows whose frontier is found without cutting them into ranges
FEW_ROWS = 10_000
MASTER_COLUMNS = [
    "dataset", "mode", "experiment", "model", "kind",
    "accuracy", "macro_f1", "balanced_acc", "MCC", "FAR", "DR",
]


def master_table(parts: Sequence[tuple[str | Column, DataFrame]]) -> DataFrame:
    """Result tables under one schema, each with its experiment name; gaps are null."""
    renamed = {"balanced_accuracy": "balanced_acc", "mcc": "MCC", "far": "FAR", "dr": "DR"}
    named = []
    for experiment, df in parts:
        label = F.lit(experiment) if isinstance(experiment, str) else experiment
        for old, new in renamed.items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        df = df.withColumn("experiment", label)
        named.append(df.select(*[c for c in MASTER_COLUMNS if c in df.columns]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    missing = [c for c in MASTER_COLUMNS if c not in whole.columns]
    whole = whole.withColumns({c: F.lit(None).cast("string") for c in missing})
    return whole.select(*MASTER_COLUMNS)


def headline(
    master: DataFrame,
    preferred: Sequence[str] = ("E7_multiseed",),
    otherwise: Sequence[str] = ("E7_LLM_subset", "E7_anchor_full"),
) -> DataFrame:
    """Rows of the preferred experiments, or of the fall-backs when there are none."""
    wanted = master.where(F.col("experiment").isin([*preferred, *otherwise]))
    first = F.col("experiment").isin(list(preferred))
    any_first = wanted.agg(F.max(first).alias("found")).first()["found"]
    kept = wanted.where(first if any_first else ~first)
    return kept.orderBy("dataset", "kind", F.desc("MCC"))


def best_flag(df: DataFrame, metric: str, group: Sequence[str]) -> DataFrame:
    top = F.max(metric).over(Window.partitionBy(*group))
    return df.withColumn("is_best", F.coalesce(F.col(metric) == top, F.lit(False)))


def pareto_frontier(df: DataFrame, cost: str, gain: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows whose gain beats every cheaper row's (record highs along rising cost).

    Of rows of equal cost only the best can be a record, and tasks drop the others before any
    are moved. The rest is cut into ranges of cost: a row is a record if it beats those
    before it in its range and the maxima of all earlier ranges. A small table skips the ranges.
    """
    group = list(group)
    usable = df.where(F.col(cost).isNotNull() & F.col(gain).isNotNull())
    best = Window.partitionBy(*group, cost).orderBy(F.desc(gain), "model")
    rows = usable.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
    held = collect_bounded(rows, FEW_ROWS)
    if held is not None:
        ranged = df.sparkSession.createDataFrame(held, rows.schema).withColumn("_range", F.lit(0))
    else:
        ranged = with_sort_range(materialise(rows), cost, "_range")
    place = Window.partitionBy(*group, "_range").orderBy(cost)
    inside = F.max(gain).over(place.rowsBetween(Window.unboundedPreceding, -1))
    records = ranged.withColumn("_record", F.coalesce(inside, F.lit(-1.0))).where(F.col(gain) > F.col("_record"))
    if held is None:
        highs = ranged.groupBy(*group, "_range").agg(F.max(gain).alias("_high"))
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = highs.select(*group, "_range", F.coalesce(F.max("_high").over(earlier), F.lit(-1.0)).alias("_before"))
        records = join_strata(records, before, [*group, "_range"]).where(F.col(gain) > F.col("_before")).drop("_before")
    return records.drop("_record", "_range")


def wide_table(
    df: DataFrame, rows: Sequence[str], columns: str, names: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Long to wide with listed column names, so no extra pass looks for them."""
    cells = [F.first(v, ignorenulls=True).alias(v) for v in values]
    return df.groupBy(*rows).pivot(columns, list(names)).agg(*cells)


def cost_table(results: DataFrame, n_test: str = "n_test") -> DataFrame:
    """Cost, tokens and latency per sample, and cost per right answer.

    Needs accuracy, prompt_tok, completion_tok, wall_s and the two rates per million
    tokens (price_in, price_out). A model without a rate has null costs.
    """
    rows = F.greatest(F.lit(1), F.col(n_test))
    tokens = F.col("prompt_tok") + F.col("completion_tok")
    cost = (
        F.col("prompt_tok") * F.col("price_in") + F.col("completion_tok") * F.col("price_out")
    ) / 1e6
    right = F.greatest(F.lit(1.0), F.col("accuracy") * F.col(n_test))
    return (
        results.withColumn("tok_per_sample", tokens / rows)
        .withColumn("lat_per_sample_s", F.col("wall_s") / rows)
        .withColumn("cost_usd", cost)
        .withColumn("cost_per_correct_usd", F.col("cost_usd") / right)
        .orderBy(F.asc_nulls_last("cost_per_correct_usd"))
    )


def reprice(costs: DataFrame) -> DataFrame:
    """New cost and cost per right answer; the sample count comes back from the old ratio."""
    accuracy = F.greatest(F.col("accuracy"), F.lit(1e-9))
    n_test = F.rint(
        F.try_divide(F.col("cost_usd"), F.col("cost_per_correct_usd") * accuracy)
    ).cast("long")
    new = (
        F.col("prompt_tok") / 1e6 * F.col("price_in")
        + F.col("completion_tok") / 1e6 * F.col("price_out")
    )
    return (
        costs.withColumn("cost_usd_new", new)
        .withColumn("n_test", n_test)
        .withColumn(
            "cost_per_correct_usd_new",
            F.try_divide(F.col("cost_usd_new"), accuracy * F.col("n_test")),
        )
        .withColumn("price_changed", F.abs(F.col("cost_usd_new") - F.col("cost_usd")) > 1e-5)
    )


def price_spread(costs: DataFrame, cost: str, group: Sequence[str] = ()) -> DataFrame:
    """Cheapest and dearest model and the ratio of their costs."""
    return costs.groupBy(*group).agg(
        F.min_by("model", F.struct(cost, "model")).alias("cheapest"),
        F.max_by("model", F.struct(cost, "model")).alias("dearest"),
        F.try_divide(F.max(cost), F.min(cost)).alias("ratio"),
    )


def arm_delta(
    df: DataFrame,
    group: Sequence[str],
    arm_col: str,
    base: str,
    other: str,
    metrics: Sequence[str],
    places: int = 4,
) -> DataFrame:
    """Mean of ``other`` minus mean of ``base`` per metric, in one aggregate."""

    def mean(arm: str, metric: str) -> Column:
        return F.avg(F.when(F.col(arm_col) == arm, F.col(metric)))

    deltas = [
        F.round(mean(other, m) - mean(base, m), places).alias(f"delta_{m}") for m in metrics
    ]
    return df.groupBy(*group).agg(*deltas)


def mean_and_spread(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per metric."""
    cells = []
    for m in metrics:
        cells += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*group).agg(*cells)


def metric_curve(
    df: DataFrame, group: Sequence[str], step: str, metrics: Sequence[str]
) -> DataFrame:
    """Mean and population deviation at each step (shots, features), in step order."""
    cells = []
    for m in metrics:
        cells += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return (
        df.groupBy(*group, step)
        .agg(*cells, F.count(F.lit(1)).alias("n_runs"))
        .orderBy(*group, step)
    )


def budget_curve(
    df: DataFrame, group: Sequence[str], step: str, order: Sequence[str], metric: str
) -> DataFrame:
    """Mean metric per feature budget, in a listed order ("all" has no numeric order)."""
    place = F.array_position(F.array(*[F.lit(str(o)) for o in order]), F.col(step).cast("string"))
    return (
        df.groupBy(*group, F.col(step).cast("string").alias(step))
        .agg(F.avg(metric).alias(metric))
        .withColumn("step_order", place.cast("int"))
        .where(F.col("step_order") > 0)
        .orderBy(*group, "step_order")
    )


def model_comparison(
    runs: DataFrame, metrics: Sequence[str], model_col: str = "model"
) -> DataFrame:
    """One row per model with mean ± std texts; a model that only failed keeps its error."""
    from gridvigil.functions.statistics import mean_std_text

    cells = [
        F.when(F.avg(m).isNotNull(), mean_std_text(F.avg(m), F.stddev_pop(m))).alias(m)
        for m in metrics
    ]
    good = F.count(F.when(F.col("error").isNull(), 1))
    return runs.groupBy(model_col).agg(
        *cells,
        good.alias("n_runs"),
        F.when(good == 0, F.min("error")).alias("error"),
    )


def rare_summary(metrics: DataFrame, rare: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall macro F1 beside the rare-class metrics."""
    overall = metrics.select(*keys, F.col("macro_f1").alias("overall_f1_macro"))
    return overall.join(rare, list(keys), "left")


def by_overall_mean(df: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(metric).alias(metric)).orderBy(F.desc(metric), *group)


def distinct_inputs(paths: DataFrame, path_col: str = "path") -> DataFrame:
    return paths.dropDuplicates([path_col])
