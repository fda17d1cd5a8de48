"""Registered queries for detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.operators import scoring
from gridvigil.plans.detections import (
    CLASSES,
    DETECTIONS_SQL,
    METRICS,
    detections,
    metrics_sql,
    rounded,
    rounded_sql,
)
from gridvigil.plans.registry import query, table

RUN = ["dataset", "model", "seed"]
RUN_SQL = "dataset, model, seed"


def _counts(spark, sf, run=RUN):
    return scoring.confusion_counts(detections(spark, sf), run)


def _with(body: str, run: str = RUN_SQL, **kwargs) -> str:
    return f"WITH {DETECTIONS_SQL}, {metrics_sql(run, **kwargs)} {body}"


@query("confusion_counts", _with("SELECT * FROM conf"))
def confusion_counts(spark, sf):
    return _counts(spark, sf)


_LABELS = [*CLASSES, scoring.NO_PREDICTION]


@query(
    "confusion_matrix",
    _with(
        "SELECT dataset, model, seed, y_true, "
        + ", ".join(
            f"CAST(coalesce(sum(n) FILTER (y_pred = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _LABELS
        )
        + " FROM conf GROUP BY ALL"
    ),
)
def confusion_matrix(spark, sf):
    return scoring.confusion_matrix(_counts(spark, sf), RUN, _LABELS)


@query(
    "normalised_confusion",
    _with(
        """SELECT dataset, model, seed, y_true, y_pred, n,
        round(n / sum(n) OVER (PARTITION BY dataset, model, seed, y_true), 9) AS share FROM conf"""
    ),
)
def normalised_confusion(spark, sf):
    return rounded(scoring.normalised_confusion(_counts(spark, sf), RUN), ["share"])


@query(
    "class_scores",
    _with(
        f"SELECT {RUN_SQL}, class, support, predicted, hits, "
        f"{rounded_sql(['precision', 'recall', 'f1'])} FROM cls"
    ),
)
def class_scores(spark, sf):
    return rounded(scoring.class_scores(_counts(spark, sf), RUN), ["precision", "recall", "f1"])


@query("detection_metrics", _with(f"SELECT {RUN_SQL}, n, {rounded_sql(METRICS)} FROM met"))
def detection_metrics(spark, sf):
    return rounded(scoring.detection_metrics(_counts(spark, sf), RUN), METRICS)


@query(
    "detection_metrics_true_classes",
    _with(f"SELECT {RUN_SQL}, n, {rounded_sql(METRICS)} FROM met", class_set="true"),
)
def detection_metrics_true_classes(spark, sf):
    return rounded(
        scoring.detection_metrics(_counts(spark, sf), RUN, class_set="true"), METRICS
    )


FLOWS_SQL = """flow AS (
  SELECT l_linestatus AS dataset, CASE WHEN l_returnflag = 'N' THEN 'Normal' ELSE 'Attack' END AS y_true,
    CASE WHEN l_discount > 0.05 THEN 'Attack' ELSE 'Normal' END AS y_pred,
    l_discount AS discount, l_tax AS tax
  FROM lineitem)"""


def flow_alarms(spark, sf):
    """Binary threshold detector on lineitem."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("dataset"),
        F.when(F.col("l_returnflag") == "N", "Normal").otherwise("Attack").alias("y_true"),
        F.when(F.col("l_discount") > 0.05, "Attack").otherwise("Normal").alias("y_pred"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


@query(
    "detection_metrics_binary",
    f"WITH {FLOWS_SQL}, {metrics_sql('dataset', 'flow')} SELECT dataset, n, {rounded_sql(METRICS)} FROM met",
)
def detection_metrics_binary(spark, sf):
    counts = scoring.confusion_counts(flow_alarms(spark, sf), ["dataset"])
    return rounded(scoring.detection_metrics(counts, ["dataset"]), METRICS)


@query(
    "classification_report",
    _with(
        f"""SELECT {RUN_SQL}, class AS line, round(precision, 9) AS precision,
          round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM cls
        UNION ALL SELECT {RUN_SQL}, 'macro avg', round(macro_precision, 9), round(macro_recall, 9),
          round(macro_f1, 9), n FROM met
        UNION ALL SELECT {RUN_SQL}, 'weighted avg', round(weighted_precision, 9),
          round(weighted_recall, 9), round(weighted_f1, 9), n FROM met
        UNION ALL SELECT {RUN_SQL}, 'accuracy', NULL, NULL, round(accuracy, 9), n FROM met"""
    ),
)
def classification_report(spark, sf):
    return rounded(
        scoring.classification_report(_counts(spark, sf), RUN), ["precision", "recall", "f1"]
    )


@query(
    "collapse_guard",
    _with(
        f"""SELECT {RUN_SQL}, round(far, 9) AS far, round(dr, 9) AS dr,
        CASE WHEN far > 0.30::DOUBLE THEN 'false alarms' WHEN dr < 0.10::DOUBLE THEN 'no detection'
        ELSE 'ok' END AS guard FROM met"""
    ),
)
def collapse_guard(spark, sf):
    metrics = scoring.detection_metrics(_counts(spark, sf), RUN)
    return rounded(scoring.collapse_guard(metrics).select(*RUN, "far", "dr", "guard"), ["far", "dr"])


RARE = 200
_RARE_SQL = f"""rare AS (SELECT {RUN_SQL}, y_true FROM conf GROUP BY ALL
  HAVING sum(n) < {RARE} AND y_true <> 'Normal'),
sub AS (SELECT c.dataset, c.model, c.seed, c.y_true, c.y_pred, c.n FROM conf c
  JOIN rare USING ({RUN_SQL}, y_true))"""


@query(
    "rare_class_metrics",
    _with("").rstrip()
    + f""", {_RARE_SQL},
  per AS (SELECT {RUN_SQL}, y_true AS class, sum(n) AS support,
     sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS hits FROM sub GROUP BY ALL),
  pre AS (SELECT {RUN_SQL}, y_pred AS class, sum(n) AS predicted FROM sub GROUP BY ALL),
  f AS (SELECT dataset, model, seed, 2 * coalesce(hits, 0)
      / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1
    FROM per FULL JOIN pre USING ({RUN_SQL}, class)),
  s AS (SELECT {RUN_SQL}, CAST(sum(n) AS BIGINT) AS n_rare,
     round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n), 9) AS rare_accuracy,
     round(sum(CASE WHEN y_pred <> 'Normal' THEN n ELSE 0 END) / sum(n), 9) AS rare_detection_rate
     FROM sub GROUP BY ALL),
  m AS (SELECT {RUN_SQL}, round(avg(f1), 9) AS rare_f1_macro FROM f GROUP BY ALL)
  SELECT b.dataset, b.model, b.seed, n_rare, rare_accuracy, rare_f1_macro, rare_detection_rate,
    CASE WHEN n_rare IS NULL THEN 'No classes with <{RARE} samples' END AS message
  FROM (SELECT DISTINCT {RUN_SQL} FROM conf) b LEFT JOIN s USING ({RUN_SQL}) LEFT JOIN m USING ({RUN_SQL})""",
)
def rare_class_metrics(spark, sf):
    return rounded(
        scoring.rare_class_metrics(_counts(spark, sf), RUN, RARE),
        ["rare_accuracy", "rare_f1_macro", "rare_detection_rate"],
    )


@query("class_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def class_distribution(spark, sf):
    return scoring.class_distribution(table(spark, sf, "events"), "event_type")


@query(
    "dataset_profile",
    """WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_linestatus, CAST(sum(n) AS BIGINT) AS n_samples, 4 AS n_features, count(*) AS n_classes,
      string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS distribution,
      round(max(n) / min(n), 9) AS imbalance_ratio FROM c GROUP BY l_linestatus""",
)
def dataset_profile(spark, sf):
    profile = scoring.dataset_profile(
        table(spark, sf, "lineitem"),
        "l_returnflag",
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_linestatus"],
    )
    text = F.array_join(
        F.transform(
            F.map_entries("class_distribution"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )
    shown = profile.withColumn("distribution", text).drop("class_distribution")
    return rounded(shown, ["imbalance_ratio"])


@query(
    "parse_rate",
    f"""WITH {DETECTIONS_SQL}
    SELECT model, count(*) AS n_candidates, round(avg(CASE WHEN y_pred IS NULL THEN 0 ELSE 1 END), 9) AS parse_rate
    FROM det GROUP BY model""",
)
def parse_rate(spark, sf):
    answers = detections(spark, sf).withColumn("candidates", F.array("y_pred"))
    return rounded(scoring.parse_rate(answers, ["model"]), ["parse_rate"])


def curve_sql(run: str, positive: str, source: str, score: str) -> str:
    return f"""
st AS (SELECT {run}, {score} AS threshold, count(*) FILTER ({positive}) AS pos,
    count(*) FILTER (NOT ({positive})) AS neg FROM {source} WHERE {score} IS NOT NULL GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY {run}) AS n_pos, sum(neg) OVER (PARTITION BY {run}) AS n_neg
  FROM st WINDOW w AS (PARTITION BY {run} ORDER BY threshold DESC))"""


_AREA_SQL = """round(CASE WHEN first(n_pos) * first(n_neg) > 0 THEN
    sum(neg * (tp - pos + pos / 2)) / (first(n_pos) * first(n_neg)) END, 9) AS auroc,
  round(CASE WHEN first(n_pos) * first(n_neg) > 0 THEN
    sum(pos * tp / (tp + fp)) / first(n_pos) END, 9) AS auprc"""


@query(
    "auroc_auprc",
    f"""WITH {DETECTIONS_SQL}, {curve_sql(RUN_SQL, "y_true <> 'Normal'", "det", "score")}
    SELECT {RUN_SQL}, {_AREA_SQL} FROM curve GROUP BY ALL""",
)
def auroc_auprc(spark, sf):
    curve = scoring.score_curve(detections(spark, sf), RUN, F.col("y_true") != "Normal")
    return rounded(scoring.area_metrics(curve, RUN), ["auroc", "auprc"])


@query(
    "auroc_tied_scores",
    f"""WITH {FLOWS_SQL}, {curve_sql("dataset", "y_true <> 'Normal'", "flow", "discount")}
    SELECT dataset, {_AREA_SQL} FROM curve GROUP BY ALL""",
)
def auroc_tied_scores(spark, sf):
    curve = scoring.score_curve(
        flow_alarms(spark, sf), ["dataset"], F.col("y_true") != "Normal", "discount"
    )
    return rounded(scoring.area_metrics(curve, ["dataset"]), ["auroc", "auprc"])


@query(
    "roc_and_pr_points",
    f"""WITH {DETECTIONS_SQL}, {curve_sql("model, seed", "y_true <> 'Normal'", "det", "score")}
    SELECT model, seed, threshold, round(fp / n_neg, 9) AS fpr, round(tp / n_pos, 9) AS tpr,
      round(tp / (tp + fp), 9) AS precision, round(tp / n_pos, 9) AS recall FROM curve""",
)
def roc_and_pr_points(spark, sf):
    run = ["model", "seed"]
    curve = scoring.score_curve(detections(spark, sf), run, F.col("y_true") != "Normal")
    return rounded(scoring.curve_points(curve, run), ["fpr", "tpr", "precision", "recall"])


@query(
    "auroc_one_vs_rest",
    f"""WITH {DETECTIONS_SQL},
    p AS (SELECT model, seed, y_true, c.cls,
        CASE WHEN c.cls = coalesce(y_pred, 'Normal') THEN conf ELSE (1 - conf) / 4 END AS score
      FROM det, (VALUES {", ".join(f"('{c}')" for c in CLASSES)}) c(cls)),
    {curve_sql("model, seed, cls", "y_true = cls", "(SELECT * REPLACE (round(score, 6) AS score) FROM p)", "score")},
    a AS (SELECT model, seed, cls, sum(neg * (tp - pos + pos / 2)) / (first(n_pos) * first(n_neg)) AS auroc
      FROM curve GROUP BY ALL)
    SELECT model, seed, round(avg(auroc), 9) AS auroc_ovr, count(auroc) AS n_classes FROM a GROUP BY ALL""",
)
def auroc_one_vs_rest(spark, sf):
    scored = detections(spark, sf).withColumns({
        "told": F.coalesce("y_pred", F.lit("Normal")),
        "own": F.round("conf", 6),
        "rest": F.round((1 - F.col("conf")) / 4, 6),
    })
    pairs = []
    for c in CLASSES:
        pairs += [F.lit(c), F.when(F.col("told") == c, F.col("own")).otherwise(F.col("rest"))]
    scored = scored.withColumn("proba", F.create_map(*pairs))
    return rounded(
        scoring.auroc_one_vs_rest(scored, ["model", "seed"], "proba"), ["auroc_ovr"]
    )
