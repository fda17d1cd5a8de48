"""Combining detectors: routers, cascades, votes, look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import broadcast_if_small
from gridvigil.operators.scoring import (
    class_scores,
    confusion_counts,
    detection_metrics,
    fill_missing_prediction,
)

# --- fixed values: confidence thresholds of the cascade sweep ---
TAUS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)


def route_by_prediction(pairs: DataFrame, rare: Sequence[str]) -> DataFrame:
    """Take the second detector's answer where the first predicts a rare class."""
    asked = F.coalesce(F.col("a_y_pred").isin(list(rare)), F.lit(False))
    return pairs.withColumn("asked", asked).withColumn(
        "y_pred", F.when(asked, F.col("b_y_pred")).otherwise(F.col("a_y_pred"))
    )


def cascade(pairs: DataFrame, taus: Sequence[float] = TAUS, conf: str = "a_conf") -> DataFrame:
    """One copy of each row per threshold; escalate where confidence is below it."""
    swept = pairs.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    asked = F.coalesce(F.col(conf) < F.col("tau"), F.lit(True))
    return swept.withColumn("asked", asked).withColumn(
        "y_pred", F.when(asked, F.col("b_y_pred")).otherwise(F.col("a_y_pred"))
    )


def combined_metrics(combined: DataFrame, run: Sequence[str], class_set: str = "true") -> DataFrame:
    """Metrics of a router or cascade with the share of rows sent to the second detector."""
    counts = combined.groupBy(
        *run, "y_true", fill_missing_prediction("y_pred").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("long")).alias("asked_n"))
    metrics = detection_metrics(counts, run, class_set=class_set, carry=["asked_n"])
    return metrics.withColumn("asked_share", F.col("asked_n") / F.col("n")).drop("asked_n")


def oracle_choice(
    df: DataFrame, group: Sequence[str], first: str, second: str, seed_col: str = "seed"
) -> DataFrame:
    """Per true class the model with the higher seed-mean F1; ties go to ``first``."""
    run = [*group, "model", seed_col]
    scores = class_scores(confusion_counts(df, run), run).where(F.col("support") > 0)
    side = lambda m: F.avg(F.when(F.col("model") == m, F.col("f1")))
    means = scores.groupBy(*group, "class").agg(side(first).alias("f1_a"), side(second).alias("f1_b"))
    better = F.coalesce(F.col("f1_a") >= F.col("f1_b"), F.lit(False))
    return means.withColumn("winner", F.when(better, first).otherwise(second))


def oracle_route(
    pairs: DataFrame, choice: DataFrame, group: Sequence[str], first: str
) -> DataFrame:
    """Apply ``oracle_choice`` by true class; a class without a choice takes the second."""
    picked = broadcast_if_small(choice.select(*group, F.col("class").alias("y_true"), "winner"))
    joined = pairs.join(picked, [*group, "y_true"], "left")
    return joined.withColumn(
        "y_pred",
        F.when(F.col("winner") == first, F.col("a_y_pred")).otherwise(F.col("b_y_pred")),
    )


def majority_vote(candidates: str | Column = "candidates") -> Column:
    """Most frequent label of an array, nulls ignored, ties to the first seen."""
    column = F.col(candidates) if isinstance(candidates, str) else candidates
    known = F.array_compact(column)
    ballots = F.transform(
        F.array_distinct(known),
        lambda label: F.struct(
            F.size(F.filter(known, lambda other: other == label)).alias("votes"),
            (-F.array_position(known, label)).alias("seen"),
            label.alias("label"),
        ),
    )
    return F.array_max(ballots)["label"]


def vote_by_key(df: DataFrame, keys: Sequence[str], answer: str, order_col: str) -> DataFrame:
    """The same vote over rows: counts and first positions are combined map-side."""
    counts = (
        df.where(F.col(answer).isNotNull())
        .groupBy(*keys, answer)
        .agg(F.count(F.lit(1)).alias("votes"), F.min(order_col).alias("_seen"))
    )
    best = F.max_by(F.struct(answer, "votes"), F.struct(F.col("votes"), -F.col("_seen")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def fallback_label(
    df: DataFrame, run: Sequence[str], normal_label: str = "Normal", attack_label: str = "Attack"
) -> DataFrame:
    """Per run: Attack for binary labels, else the most frequent attack class."""
    counts = df.groupBy(*run, "y_true").agg(F.count(F.lit(1)).alias("n"))
    attack = F.col("y_true") != normal_label
    binary = F.bool_and(F.col("y_true").isin(normal_label, attack_label))
    ordered = Window.partitionBy(*run).orderBy(F.desc("n"), "y_true")
    ranked = counts.withColumn("_rn", F.row_number().over(ordered))
    top = F.min_by("y_true", F.when(attack, F.col("_rn")))
    return ranked.groupBy(*run).agg(F.when(binary, attack_label).otherwise(top).alias("fallback"))


def impute_unparsed(df: DataFrame, run: Sequence[str], normal_label: str = "Normal") -> DataFrame:
    """Missing predictions become the run's fallback label."""
    table = broadcast_if_small(fallback_label(df, run, normal_label))
    return (
        df.join(table, list(run), "left")
        .withColumn("y_pred", F.coalesce("y_pred", "fallback"))
        .drop("fallback")
    )


def rate_lookup(df: DataFrame, rates: DataFrame, key: str = "model") -> DataFrame:
    """Add the rates of a look-up table; an unknown key keeps nulls."""
    return df.join(broadcast_if_small(rates), key, "left")


def minus_baseline(
    results: DataFrame,
    metrics: Sequence[str],
    reference: str,
    group: Sequence[str] = ("dataset",),
    model_col: str = "model",
) -> DataFrame:
    """Add ``delta_<metric>`` = value minus the reference model's value in the same group."""
    base = results.where(F.col(model_col) == reference).select(
        *group, *[F.col(m).alias(f"_base_{m}") for m in metrics]
    )
    joined = results.join(broadcast_if_small(base), list(group), "left")
    return joined.withColumns({f"delta_{m}": F.col(m) - F.col(f"_base_{m}") for m in metrics}).drop(
        *[f"_base_{m}" for m in metrics]
    )


def best_model(results: DataFrame, metric: str, group: Sequence[str] = ()) -> DataFrame:
    """The model with the highest value; equal values go to the lower name."""
    columns = F.struct("model", metric)
    lowest = F.min_by(columns, F.struct(-F.col(metric), F.col("model"))).alias("_best")
    return results.where(F.col(metric).isNotNull()).groupBy(*group).agg(lowest).select(
        *group, "_best.*"
    )


def top_models(
    results: DataFrame, metric: str, n: int, forced: str, group: Sequence[str] = ()
) -> DataFrame:
    """``n`` distinct models per group: the forced one, then by metric."""
    single = results.groupBy(*group, "model").agg(F.max(metric).alias(metric))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = part.orderBy((F.col("model") != forced).cast("int"), F.desc(metric), "model")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
