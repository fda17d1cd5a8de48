"""Classifiers with one interface, and batch scoring of outside models.

``fit`` returns a detector whose ``predict`` adds ``y_pred`` and ``proba`` (map of class
to probability) to a table. Training and scoring are Spark ML jobs on the cluster.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridvigil.functions.bounded import collect_bounded, materialise
from gridvigil.operators import boosting as trees
from gridvigil.operators.sampling import MAX_STRATA, with_class_weight

# --- fixed values: model settings ---
FOREST = {"numTrees": 200, "featureSubsetStrategy": "sqrt", "maxDepth": 30, "seed": 42}
TREE = {"maxDepth": 8, "seed": 42}
BOOST = {"rounds": 200, "depth": 8, "rate": 0.1}
LEAF_BOOST = {"rounds": 200, "depth": 8, "rate": 0.1, "leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20}
# --- end of fixed values ---


def forest(**settings) -> Estimator:
    return RandomForestClassifier(**{**FOREST, **settings})


def tree(**settings) -> Estimator:
    return DecisionTreeClassifier(**{**TREE, **settings})


def boosting(**settings) -> trees.Boosting:
    """Second-order boosted trees that grow level by level, for any number of classes."""
    return trees.Boosting(**{**BOOST, **settings})


def leaf_boosting(**settings) -> trees.Boosting:
    """Second-order boosted trees that grow best-first."""
    return trees.Boosting(**{**LEAF_BOOST, **settings})


def class_list(df: DataFrame, label: str) -> list[str]:
    rows = collect_bounded(df.select(label).distinct(), MAX_STRATA)
    if rows is None:
        raise ValueError(f"more than {MAX_STRATA} classes")
    return sorted(r[0] for r in rows)


@dataclass
class Detector:
    stages: PipelineModel
    classes: list[str]
    timing: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.stages.transform(df)
        columns = [F.col(c) for c in df.columns]
        if "probability" in scored.columns:
            shares = vector_to_array(F.col("probability"))
            proba = F.map_from_arrays(F.array(*[F.lit(c) for c in self.classes]), shares)
            columns.append(proba.alias("proba"))
        return scored.select(*columns, "y_pred")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> Detector:
        stages = PipelineModel.load(path)
        names = next(s for s in stages.stages if isinstance(s, IndexToString)).getLabels()
        return Detector(stages, list(names))


def fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Estimator | trees.Boosting,
    balanced: bool = True,
) -> Detector | trees.BoostedDetector:
    """Train on ``df``; ``balanced`` weights rows by inverse class frequency."""
    if isinstance(estimator, trees.Boosting):
        data = df.select(*[F.col(f"`{c}`") for c in [*features, label]])
        if balanced:
            data = with_class_weight(data, label, "_weight")
        return trees.fit(data, features, label, estimator, "_weight" if balanced else None)
    start = time.perf_counter()
    # The class list, the weights, the codes and the trees read the rows: they are drawn and dealt out once.
    data = materialise(df.select(*features, label))
    classes = class_list(data, label)
    if len(classes) < 2:
        raise ValueError(f"column {label} holds a single class")
    model = estimator.copy().setFeaturesCol("_features").setLabelCol("_code")
    if balanced:
        data = with_class_weight(data, label, "_weight")
        model.setWeightCol("_weight")
    indexer = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc")
    coded = indexer.fit(data)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    fitted = Pipeline(stages=[assembler, model]).fit(coded.transform(data))
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=coded.labels)
    detector = Detector(PipelineModel([*fitted.stages, back]), list(coded.labels))
    detector.timing["fit_s"] = time.perf_counter() - start
    return detector


# --- scores from probabilities ---------------------------------------------------------------


def attack_score(proba: str | Column = "proba", normal_label: str = "Normal") -> Column:
    """Sum of the probabilities of all classes but the normal one."""
    column = F.col(proba) if isinstance(proba, str) else proba
    shares = F.map_values(F.map_filter(column, lambda c, _: c != normal_label))
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total + p)


def confidence(proba: str | Column = "proba") -> Column:
    column = F.col(proba) if isinstance(proba, str) else proba
    return F.array_max(F.map_values(column))


def most_likely(proba: str | Column = "proba") -> Column:
    """Class with the highest probability, ties to the first class."""
    column = F.col(proba) if isinstance(proba, str) else proba
    ranked = F.transform(
        F.map_entries(column), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("c"))
    )
    return F.array_min(ranked)["c"]


# --- outside models ------------------------------------------------------------------------------


def score_batches(
    df: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batch_rows: int = 50_000,
) -> DataFrame:
    """Run any vectorised scorer over ``df``; no batch is larger than ``batch_rows``.

    ``scorer`` maps a pandas frame to one with the columns of ``schema``. Partitions are
    scored in parallel, so the batch size bounds memory, not throughput.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield scorer(batch.iloc[start : start + batch_rows])

    return df.mapInPandas(run, schema)


def timed(action: Callable[[], object]) -> tuple[object, float]:
    start = time.perf_counter()
    result = action()
    return result, time.perf_counter() - start
