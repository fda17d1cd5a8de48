"""Model comparison, few-shot sweep and rare-attack study as joined-up jobs.

Predictions of all models, seeds and shot counts go into one long table, so each study
is scored by one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridvigil.operators import reports, scoring
from gridvigil.operators.classifiers import fit
from gridvigil.operators.sampling import per_class, stratified_split

# --- fixed values: shots, runs and first seed ---
SHOTS = (5, 10, 25, 50, 100, 500)
RUNS = 10
FIRST_SEED = 42

Models = dict[str, Callable[[], Estimator]]


def _failed(df: DataFrame, error: Exception, **keys) -> DataFrame:
    row = {**keys, "error": f"{type(error).__name__}: {error}"[:500]}
    return df.sparkSession.createDataFrame([row])


def _predict(train, test, features, label, key, make, **keys) -> DataFrame:
    detector = fit(train, features, label, make())
    scored = detector.predict(test).select(key, F.col(label).alias("y_true"), "y_pred")
    return scored.withColumns({name: F.lit(value) for name, value in keys.items()})


def compare_models(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    models: Models,
    seeds: Sequence[int] = (42, 43, 44),
    test_size: float = 0.3,
) -> tuple[DataFrame, list[DataFrame]]:
    """(predictions of every model and seed, one table per failed fit)."""
    scored, failed = [], []
    for seed in seeds:
        parts = stratified_split(df.select(key, *features, label), label, [key], test_size, seed)
        train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
        for name, make in models.items():
            try:
                scored.append(
                    _predict(train, test, features, label, key, make, model=name, seed=seed)
                )
            except Exception as error:  # noqa: BLE001 - a failed model becomes a row
                failed.append(_failed(df, error, model=name, seed=seed))
    return reduce(DataFrame.unionByName, scored), failed


def comparison_table(
    predictions: DataFrame, failed: Sequence[DataFrame] = (), metrics=("accuracy", "macro_f1", "mcc")
) -> DataFrame:
    run = ["model", "seed"]
    rows = scoring.detection_metrics(scoring.confusion_counts(predictions, run), run)
    rows = rows.select(*run, *metrics).withColumn("error", F.lit(None).cast("string"))
    for part in failed:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return reports.model_comparison(rows, metrics)


def few_shot_sweep(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    models: Models,
    shots: Sequence[int] = SHOTS,
    runs: int = RUNS,
    test_size: float = 0.3,
) -> DataFrame:
    """(model, k, seed, key, y_true, y_pred): one shared test part, nested training sets.

    The samples of every k of a seed are prefixes of one draw.
    """
    parts = stratified_split(df.select(key, *features, label), label, [key], test_size, FIRST_SEED)
    train = parts.where("part = 'train'").select(key, *features, label)
    test = parts.where("part = 'test'").select(key, *features, label)
    scored = []
    for seed in range(FIRST_SEED, FIRST_SEED + runs):
        for k in shots:
            sample = per_class(train, label, k, [key], [seed]).select(key, *features, label)
            for name, make in models.items():
                scored.append(
                    _predict(sample, test, features, label, key, make, model=name, k=k, seed=seed)
                )
    return reduce(DataFrame.unionByName, scored)


def few_shot_table(predictions: DataFrame, metrics=("accuracy", "macro_f1", "mcc")) -> DataFrame:
    run = ["model", "k", "seed"]
    rows = scoring.detection_metrics(scoring.confusion_counts(predictions, run), run)
    return reports.metric_curve(rows, ["model"], "k", list(metrics))


def rare_attack_table(predictions: DataFrame, threshold: int = 50) -> DataFrame:
    """Overall and rare-class metrics per model."""
    run = ["model", "seed"]
    counts = scoring.confusion_counts(predictions, run)
    overall = scoring.detection_metrics(counts, run)
    rare = scoring.rare_class_metrics(counts, run, threshold)
    return reports.rare_summary(overall, rare, run)
