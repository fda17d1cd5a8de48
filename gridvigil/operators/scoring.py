"""Detection metrics.

All point metrics come from one aggregate: counts by (run keys, true label, predicted
label). Every run in the table is scored in the same job. AUROC, AUPRC and curve points
come from counts by distinct score, accumulated range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import materialise
from gridvigil.operators.ordering import with_sort_range

NO_PREDICTION = "<NONE>"


def _ratio(top: Column, bottom: Column, empty=0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def fill_missing_prediction(pred: str | Column = "y_pred") -> Column:
    column = F.col(pred) if isinstance(pred, str) else pred
    return F.coalesce(column, F.lit(NO_PREDICTION))


def confusion_counts(
    df: DataFrame, run: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """(run, y_true, y_pred, n); a missing prediction counts as its own label."""
    return df.groupBy(
        *run, F.col(y_true).alias("y_true"), fill_missing_prediction(y_pred).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, run: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return (
        counts.groupBy(*run, "y_true").pivot("y_pred", list(labels)).agg(F.sum("n")).na.fill(0)
    )


def normalised_confusion(counts: DataFrame, run: Sequence[str]) -> DataFrame:
    row = Window.partitionBy(*run, "y_true")
    return counts.withColumn("share", _ratio(F.col("n"), F.sum("n").over(row)))


def _class_sums(
    counts: DataFrame, run: Sequence[str], normal_label: str, carry: Sequence[str] = ()
) -> DataFrame:
    """(run, class, support, predicted, hits, alarms, carried sums) in one aggregate.

    Every confusion cell speaks for its true class and for its predicted class. ``alarms``
    are rows of the true class that were predicted as anything but normal.
    """
    zero = F.lit(0).cast("long")
    n, same = F.col("n"), F.col("y_true") == F.col("y_pred")
    as_true = F.struct(
        F.col("y_true").alias("class"),
        n.alias("support"),
        zero.alias("predicted"),
        F.when(same, n).otherwise(zero).alias("hits"),
        F.when(F.col("y_pred") != normal_label, n).otherwise(zero).alias("alarms"),
        *[F.col(c).cast("long").alias(c) for c in carry],
    )
    as_predicted = F.struct(
        F.col("y_pred").alias("class"),
        zero.alias("support"),
        n.alias("predicted"),
        zero.alias("hits"),
        zero.alias("alarms"),
        *[zero.alias(c) for c in carry],
    )
    sums = ("support", "predicted", "hits", "alarms", *carry)
    return (
        counts.select(*run, F.inline(F.array(as_true, as_predicted)))
        .groupBy(*run, "class")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def _with_scores(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")),
        }
    )


def class_scores(counts: DataFrame, run: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted label."""
    return _with_scores(_class_sums(counts, run, "")).drop("alarms")


def detection_metrics(
    counts: DataFrame,
    run: Sequence[str],
    normal_label: str = "Normal",
    class_set: str = "union",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row of metrics per run.

    ``class_set`` picks the labels of the macro averages: ``union`` of true and predicted
    labels, or ``true`` labels only. ``carry`` names count columns to sum along.
    """
    if class_set not in ("union", "true"):
        raise ValueError("class_set is 'union' or 'true'")
    scores = _with_scores(_class_sums(counts, run, normal_label, carry))
    is_true = F.col("support") > 0
    counted = is_true if class_set == "true" else F.lit(True)
    normal = F.col("class") == normal_label
    size = F.sum("support")

    def macro(name: str) -> Column:
        return F.avg(F.when(counted, F.col(name))).alias(f"macro_{name}")

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("support")) / size).alias(f"weighted_{name}")

    def among(name: str, rule: Column) -> Column:
        return F.sum(F.when(rule, F.col(name)).otherwise(0))

    def product(a: str, b: str) -> Column:
        return F.sum(F.col(a).cast("double") * F.col(b).cast("double"))

    shown = ("precision", "recall", "f1")
    total, right = size.cast("double"), F.sum("hits").cast("double")
    spread = (total * total - product("predicted", "predicted")) * (
        total * total - product("support", "support")
    )
    covariance = right * total - product("support", "predicted")
    return scores.groupBy(*run).agg(
        size.alias("n"),
        _ratio(F.sum("hits"), size).alias("accuracy"),
        F.avg(F.when(is_true, F.col("recall"))).alias("balanced_accuracy"),
        *[macro(m) for m in shown],
        *[weighted(m) for m in shown],
        F.when(spread > 0, covariance / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("mcc"),
        _ratio(among("alarms", normal), among("support", normal), None).alias("far"),
        _ratio(among("alarms", ~normal), among("support", ~normal), None).alias("dr"),
        *[F.sum(c).alias(c) for c in carry],
    )


def classification_report(counts: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per class, macro, weighted and accuracy rows in long form."""
    shown = ("precision", "recall", "f1")
    scores = class_scores(counts, run)
    size = F.sum("support")
    nothing = F.lit(None).cast("double")
    macro = F.struct(F.lit("macro avg").alias("line"), *[F.avg(m).alias(m) for m in shown])
    weighted = F.struct(
        F.lit("weighted avg").alias("line"),
        *[(F.sum(F.col(m) * F.col("support")) / size).alias(m) for m in shown],
    )
    accuracy = F.struct(
        F.lit("accuracy").alias("line"),
        nothing.alias("precision"),
        nothing.alias("recall"),
        _ratio(F.sum("hits"), size).alias("f1"),
    )
    totals = scores.groupBy(*run).agg(
        F.array(macro, weighted, accuracy).alias("_lines"), size.alias("support")
    )
    return scores.select(*run, F.col("class").alias("line"), *shown, "support").unionByName(
        totals.select(*run, F.inline("_lines"), "support")
    )


def rare_classes(
    counts: DataFrame, run: Sequence[str], threshold: int = 50, normal_label: str = "Normal"
) -> DataFrame:
    """(run, y_true, n) of the scored attack classes with fewer than ``threshold`` rows."""
    sizes = counts.groupBy(*run, "y_true").agg(F.sum("n").alias("n"))
    return sizes.where((F.col("n") < threshold) & (F.col("y_true") != normal_label))


def rare_class_metrics(
    counts: DataFrame, run: Sequence[str], threshold: int = 50, normal_label: str = "Normal"
) -> DataFrame:
    """Metrics on rows of rare classes; a run without any keeps a row with a message."""
    rare = rare_classes(counts, run, threshold, normal_label)
    subset = counts.join(rare.drop("n"), [*run, "y_true"], "left_semi")
    scored = detection_metrics(subset, run, normal_label).select(
        *run,
        F.col("n").alias("n_rare"),
        F.col("accuracy").alias("rare_accuracy"),
        F.col("macro_f1").alias("rare_f1_macro"),
        F.col("dr").alias("rare_detection_rate"),
    )
    note = F.when(F.col("n_rare").isNull(), f"No classes with <{threshold} samples")
    return (
        counts.select(*run).distinct().join(scored, list(run), "left").withColumn("message", note)
    )


def class_distribution(df: DataFrame, label: str, run: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*run, label).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(
    df: DataFrame, label: str, features: Sequence[str], run: Sequence[str] = ()
) -> DataFrame:
    """Rows, features, classes, distribution and imbalance (largest / smallest class)."""
    dist = class_distribution(df, label, run)
    return dist.groupBy(*run).agg(
        F.sum("n").alias("n_samples"),
        F.lit(len(features)).alias("n_features"),
        F.count(F.lit(1)).alias("n_classes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias(
            "class_distribution"
        ),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )


def collapse_guard(metrics: DataFrame, max_far: float = 0.30, min_dr: float = 0.10) -> DataFrame:
    """Flag runs that raise too many false alarms or detect next to nothing."""
    problem = (
        F.when(F.col("far") > max_far, "false alarms")
        .when(F.col("dr") < min_dr, "no detection")
        .otherwise("ok")
    )
    return metrics.withColumn("guard", problem)


def parse_rate(df: DataFrame, run: Sequence[str], candidates: str = "candidates") -> DataFrame:
    """Share of candidate answers that hold a label."""
    one = df.select(*run, F.explode(candidates).alias("_answer"))
    return one.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.avg(F.col("_answer").isNotNull().cast("int")).alias("parse_rate"),
    )


# --- threshold-free metrics ---------------------------------------------------------------


def score_curve(
    df: DataFrame, run: Sequence[str], positive: Column, score: str = "score"
) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first.

    Columns: run, threshold, pos, neg (at this score), tp, fp (at or above it),
    n_pos, n_neg (whole run). Rows without a score are left out.
    """
    run = list(run)
    scored = df.select(
        *run, F.col(score).cast("double").alias("threshold"), positive.cast("long").alias("_pos")
    )
    known = F.col("threshold").isNotNull()
    # Counting nothing for a missing score keeps the filter on the small aggregate.
    counted = (
        scored.groupBy(*run, "threshold")
        .agg(
            F.sum(F.when(known, F.col("_pos")).otherwise(0)).alias("pos"),
            F.sum(F.when(known, 1 - F.col("_pos")).otherwise(0)).alias("neg"),
        )
        .where(F.col("pos") + F.col("neg") > 0)
    )
    # The rows are read once; the ranges are cut from the counts by distinct score.
    steps = with_sort_range(materialise(counted), "threshold", "_range")
    parts = steps.groupBy(*run, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    whole = Window.partitionBy(*run) if run else Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *run,
        "_range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"),
        F.sum("_p").over(whole).alias("n_pos"),
        F.sum("_n").over(whole).alias("n_neg"),
    )
    inside = (
        Window.partitionBy(*run, "_range")
        .orderBy(F.desc("threshold"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        steps.withColumn("_tp", F.sum("pos").over(inside))
        .withColumn("_fp", F.sum("neg").over(inside))
        .join(offsets, [*run, "_range"])
        .select(
            *run,
            "threshold",
            "pos",
            "neg",
            (F.col("_p0") + F.col("_tp")).alias("tp"),
            (F.col("_n0") + F.col("_fp")).alias("fp"),
            "n_pos",
            "n_neg",
        )
    )


def curve_points(curve: DataFrame, run: Sequence[str]) -> DataFrame:
    """ROC and precision-recall points."""
    return curve.select(
        *run,
        "threshold",
        _ratio(F.col("fp"), F.col("n_neg"), None).alias("fpr"),
        _ratio(F.col("tp"), F.col("n_pos"), None).alias("tpr"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos"), None).alias("recall"),
    )


def area_metrics(curve: DataFrame, run: Sequence[str]) -> DataFrame:
    """AUROC (ties averaged) and average precision; null when only one class is present."""
    pairs = F.first("n_pos") * F.first("n_neg").cast("double")
    below = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    step = F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))  # a long could overflow
    return curve.groupBy(*run).agg(
        F.when(pairs > 0, below / pairs).alias("auroc"),
        F.when(pairs > 0, F.sum(step) / F.first("n_pos")).alias("auprc"),
    )


def auroc_one_vs_rest(
    df: DataFrame, run: Sequence[str], probabilities: str, y_true: str = "y_true"
) -> DataFrame:
    """Macro AUROC over classes; ``probabilities`` maps class to probability."""
    run = list(run)
    # An outer explode: before an inner one Spark filters the rows by the size of the map, pushes that filter
    # below the map's inputs, and so computes these once more for every class.
    shares = F.explode_outer(probabilities).alias("_class", "score")
    long = df.select(*run, F.col(y_true).alias("_true"), shares).where(F.col("_class").isNotNull())
    curve = score_curve(long, [*run, "_class"], F.col("_true") == F.col("_class"))
    return (
        area_metrics(curve, [*run, "_class"])
        .groupBy(*run)
        .agg(F.avg("auroc").alias("auroc_ovr"), F.count("auroc").alias("n_classes"))
    )
