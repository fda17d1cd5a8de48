"""Cross-domain transfer: train on a sample of one table, judge on all of another."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridvigil.operators.classifiers import fit
from gridvigil.operators.comparison import run_aggregate
from gridvigil.operators.features import align_feature_spaces
from gridvigil.operators.sampling import uniform_sample
from gridvigil.operators.scoring import confusion_counts, detection_metrics


def transfer_predictions(
    source: DataFrame,
    source_features: Sequence[str],
    target: DataFrame,
    target_features: Sequence[str],
    label: str,
    key: str,
    models: dict[str, Callable[[], Estimator]],
    seeds: Sequence[int] = (42, 43, 44, 45, 46),
    components: int = 25,
    train_rows: int = 5000,
) -> DataFrame:
    """(model, seed, key, y_true, y_pred) for every target row."""
    left, right, names = align_feature_spaces(
        source.select(key, *source_features, label),
        source_features,
        target.select(key, *target_features, label),
        target_features,
        components,
    )
    scored = []
    for seed in seeds:
        train = uniform_sample(left, train_rows, [key], seed)
        for name, make in models.items():
            detector = fit(train, names, label, make())
            made = detector.predict(right).select(key, F.col(label).alias("y_true"), "y_pred")
            scored.append(made.withColumns({"model": F.lit(name), "seed": F.lit(seed)}))
    return reduce(DataFrame.unionByName, scored)


def transfer_report(predictions: DataFrame, metrics: Sequence[str]) -> DataFrame:
    run = ["model", "seed"]
    scores = detection_metrics(confusion_counts(predictions, run), run)
    return run_aggregate(scores, ["model"], metrics)
