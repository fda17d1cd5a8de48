"""Inputs the registered queries derive from the given tables, and their SQL form.

``detections`` turns every order into one prediction per detector and seed. The
detectors are made up but deterministic: a digest of (model, seed, order key) decides
whether a detector is right, which label it gives otherwise, and how sure it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvigil.functions.hashing import hex_to_long, row_digest
from gridvigil.plans.registry import table

CLASSES = ["Backdoor", "CommInj", "DoS", "Normal", "Reconn"]
SEEDS = [42, 43, 44]
#: model, kind, share of right answers in 65536ths
MODELS = [
    ("alpha", "tabular", 60000),
    ("beta", "tabular", 52000),
    ("gamma", "text", 45000),
    ("delta", "text", 30000),
]


def order_label() -> Column:
    urgent = F.col("o_custkey") % 10
    return (
        F.when(F.col("o_orderpriority") == "2-HIGH", "DoS")
        .when((F.col("o_orderpriority") == "1-URGENT") & (urgent == 0), "Backdoor")
        .when((F.col("o_orderpriority") == "1-URGENT") & (urgent < 4), "CommInj")
        .when(F.col("o_orderpriority") == "1-URGENT", "Reconn")
        .otherwise("Normal")
    )


def order_dataset() -> Column:
    return (
        F.when(F.col("o_orderstatus") == "F", "plant")
        .when(F.col("o_orderstatus") == "O", "grid")
        .otherwise("flow")
    )


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        order_dataset().alias("dataset"),
        order_label().alias("y_true"),
        "o_orderdate",
        "o_totalprice",
        "o_custkey",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, model, kind, seed, row_id, y_true, y_pred, conf, score)"""
    runs = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(kind).alias("kind"),
                F.lit(skill).alias("skill"),
                F.lit(s).alias("seed"),
            )
            for m, kind, skill in MODELS
            for s in SEEDS
        ]
    )
    # narrow rows are dealt out evenly before each becomes one per run
    orders = labelled_orders(spark, sf_dir).select("row_id", "dataset", "y_true").repartition("row_id")
    base = orders.select("row_id", "dataset", "y_true", F.inline(runs))
    hashed = base.withColumn("h", row_digest(F.col("model"), "seed", "row_id"))
    drawn = hashed.withColumn("u", hex_to_long(F.col("h"), 1, 4)).withColumn(
        "v", hex_to_long(F.col("h"), 5, 4)
    )
    wrong = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("u") % 5 + 1).cast("int"))
    predicted = (
        F.when(F.col("u") < F.col("skill"), F.col("y_true"))
        .when(F.col("u") % 50 == 0, F.lit(None).cast("string"))
        .otherwise(wrong)
    )
    step = F.expr("(v * 500) div 65536")
    return drawn.withColumn("y_pred", predicted).select(
        "dataset",
        "model",
        "kind",
        "seed",
        "row_id",
        "y_true",
        "y_pred",
        ((step + F.when(F.col("u") < F.col("skill"), 500).otherwise(250)) / F.lit(1000.0)).alias(
            "conf"
        ),
        (
            (step + F.when(F.col("y_pred") == "Normal", 0).otherwise(500)) / F.lit(1000.0)
        ).alias("score"),
    )


_SKILLS = ", ".join(f"('{m}','{k}',{s})" for m, k, s in MODELS)
_SEEDS = ", ".join(f"({s})" for s in SEEDS)
_CLASSES = ", ".join(f"'{c}'" for c in CLASSES)

ORDERS_SQL = """lab AS (
  SELECT o_orderkey AS row_id,
    CASE o_orderstatus WHEN 'F' THEN 'plant' WHEN 'O' THEN 'grid' ELSE 'flow' END AS dataset,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'DoS'
         WHEN o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0 THEN 'Backdoor'
         WHEN o_orderpriority = '1-URGENT' AND o_custkey % 10 < 4 THEN 'CommInj'
         WHEN o_orderpriority = '1-URGENT' THEN 'Reconn' ELSE 'Normal' END AS y_true,
    o_orderdate, o_totalprice, o_custkey
  FROM orders)"""

DETECTIONS_SQL = f"""{ORDERS_SQL},
drawn AS (
  SELECT lab.*, m.model, m.kind, m.skill, s.seed,
    CAST('0x' || substr(md5(concat(m.model, ':', s.seed, ':', row_id)), 1, 4) AS BIGINT) AS u,
    CAST('0x' || substr(md5(concat(m.model, ':', s.seed, ':', row_id)), 5, 4) AS BIGINT) AS v
  FROM lab, (VALUES {_SKILLS}) m(model, kind, skill), (VALUES {_SEEDS}) s(seed)),
det0 AS (
  SELECT *, CASE WHEN u < skill THEN y_true WHEN u % 50 = 0 THEN NULL
    ELSE list_extract([{_CLASSES}], CAST(u % 5 + 1 AS INT)) END AS y_pred
  FROM drawn),
det AS (
  SELECT dataset, model, kind, seed, row_id, y_true, y_pred,
    ((v * 500) // 65536 + CASE WHEN u < skill THEN 500 ELSE 250 END) / 1000.0::DOUBLE AS conf,
    ((v * 500) // 65536 + CASE WHEN y_pred = 'Normal' THEN 0 ELSE 500 END) / 1000.0::DOUBLE AS score
  FROM det0)"""


def metrics_sql(run: str, source: str = "det", class_set: str = "union") -> str:
    """CTEs conf, cls and met: confusion counts, class scores and metrics per ``run``."""
    keep = "support > 0" if class_set == "true" else "TRUE"
    return f"""
conf AS (SELECT {run}, y_true, coalesce(y_pred, '<NONE>') AS y_pred, count(*) AS n
  FROM {source} GROUP BY ALL),
roles AS (
  SELECT {run}, y_true AS class, n AS support, 0 AS predicted,
    CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hits FROM conf
  UNION ALL SELECT {run}, y_pred, 0, n, 0 FROM conf),
cls0 AS (SELECT {run}, class, CAST(sum(support) AS BIGINT) AS support,
    CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hits) AS BIGINT) AS hits
  FROM roles GROUP BY ALL),
cls AS (SELECT *,
    CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1
  FROM cls0),
met1 AS (SELECT {run}, CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support) AS accuracy,
    avg(recall) FILTER (support > 0) AS balanced_accuracy,
    avg(precision) FILTER ({keep}) AS macro_precision, avg(recall) FILTER ({keep}) AS macro_recall,
    avg(f1) FILTER ({keep}) AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision,
    sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1,
    CASE WHEN (sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2))
            * (sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)) > 0
      THEN (sum(hits)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted))
        / sqrt((sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2))
             * (sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)))
      ELSE 0 END AS mcc
  FROM cls GROUP BY {run}),
met2 AS (SELECT {run},
    sum(n) FILTER (y_true = 'Normal' AND y_pred <> 'Normal')
      / nullif(sum(n) FILTER (y_true = 'Normal'), 0) AS far0,
    sum(n) FILTER (y_true = 'Normal') AS n_normal,
    sum(n) FILTER (y_true <> 'Normal' AND y_pred <> 'Normal') AS n_alarm,
    sum(n) FILTER (y_true <> 'Normal') AS n_attack
  FROM conf GROUP BY {run}),
met AS (SELECT met1.*,
    CASE WHEN n_normal > 0 THEN coalesce(far0, 0) END AS far,
    CASE WHEN n_attack > 0 THEN coalesce(n_alarm, 0) / n_attack END AS dr
  FROM met1 JOIN met2 USING ({run}))"""


METRICS = [
    "accuracy",
    "balanced_accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
    "mcc",
    "far",
    "dr",
]


def rounded(df: DataFrame, columns, places: int = 9) -> DataFrame:
    """Round for comparison with SQL, where floating sums run in another order."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def rounded_sql(columns, places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
