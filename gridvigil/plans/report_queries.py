"""Registered queries for report tables over derived results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.functions.bounded import settle
from gridvigil.functions.statistics import mean_from_text
from gridvigil.operators import ensembles, reports, scoring
from gridvigil.plans.detections import DETECTIONS_SQL, MODELS, detections, metrics_sql, rounded
from gridvigil.plans.registry import query

RUN = ["dataset", "model", "kind", "seed"]
_MET = f"WITH {DETECTIONS_SQL}, {metrics_sql('dataset, model, kind, seed')}"
SHOWN = ["accuracy", "macro_f1", "mcc", "far", "dr"]
_CORE = ["accuracy", "macro_f1", "balanced_accuracy", "mcc", "far", "dr"]


def results(spark, sf):
    counts = scoring.confusion_counts(detections(spark, sf), RUN)
    # One row per run: evaluated once, however often a report reads it.
    return settle(rounded(scoring.detection_metrics(counts, RUN), _CORE, 9))


_RES = f"""{_MET}, res AS (SELECT dataset, model, kind, seed, n, round(accuracy, 9) AS accuracy,
  round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy, round(mcc, 9) AS mcc,
  round(far, 9) AS far, round(dr, 9) AS dr FROM met)"""
_MASTER = f"""{_RES},
master AS (
  SELECT dataset, 'multi' AS mode, 'E1' AS experiment, model, kind, accuracy, macro_f1,
    balanced_accuracy AS balanced_acc, mcc AS "MCC", far AS "FAR", dr AS "DR" FROM res WHERE seed = 42
  UNION ALL SELECT dataset, 'multi', 'E2_k' || (seed - 41), model, kind, accuracy, macro_f1, NULL, mcc, far, dr FROM res
  UNION ALL SELECT dataset, 'multi', 'E7_multiseed', model, kind, round(avg(accuracy), 9), round(avg(macro_f1), 9),
    NULL, round(avg(mcc), 9), round(avg(far), 9), round(avg(dr), 9) FROM res GROUP BY dataset, model, kind)"""


def master(spark, sf):
    res = results(spark, sf).withColumn("mode", F.lit("multi"))
    single = res.where("seed = 42")
    means = res.groupBy("dataset", "mode", "model", "kind").agg(
        *[F.round(F.avg(m), 9).alias(m) for m in SHOWN]
    )
    shots = F.concat(F.lit("E2_k"), (F.col("seed") - 41).cast("string"))
    return reports.master_table(
        [("E1", single), (shots, res.drop("balanced_accuracy")), ("E7_multiseed", means)]
    )


@query("master_table", f"{_MASTER} SELECT * FROM master")
def master_table(spark, sf):
    return master(spark, sf)


@query("headline_rows", f"{_MASTER} SELECT * FROM master WHERE experiment = 'E7_multiseed'")
def headline_rows(spark, sf):
    return reports.headline(master(spark, sf))


@query(
    "best_in_group_flag",
    f"""{_MASTER} SELECT dataset, experiment, model, "MCC",
      coalesce("MCC" = max("MCC") OVER (PARTITION BY dataset, experiment), FALSE) AS is_best FROM master""",
)
def best_in_group_flag(spark, sf):
    flagged = reports.best_flag(master(spark, sf), "MCC", ["dataset", "experiment"])
    return flagged.select("dataset", "experiment", "model", "MCC", "is_best")


@query(
    "pareto_far_dr",
    f"""{_RES} SELECT dataset, seed, model, far, dr FROM res
    QUALIFY dr > coalesce(max(dr) OVER (PARTITION BY dataset, seed ORDER BY far, dr DESC, model
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""",
)
def pareto_far_dr(spark, sf):
    rows = results(spark, sf).select("dataset", "seed", "model", "far", "dr")
    return reports.pareto_frontier(rows, "far", "dr", ["dataset", "seed"])


_DATASETS = ["flow", "grid", "plant"]


@query(
    "pivot_model_by_dataset",
    f"""{_MASTER} SELECT model, """
    + ", ".join(
        f"""max(CASE WHEN dataset = '{d}' THEN {v} END) AS "{d}_{v.strip('"')}" """
        for d in _DATASETS
        for v in ("macro_f1", '"MCC"')
    )
    + " FROM master WHERE experiment = 'E7_multiseed' GROUP BY model",
)
def pivot_model_by_dataset(spark, sf):
    rows = master(spark, sf).where("experiment = 'E7_multiseed'")
    return reports.wide_table(rows, ["model"], "dataset", _DATASETS, ["macro_f1", "MCC"])


_PRICES = [("alpha", 0.02, 0.05), ("beta", 0.30, 0.90), ("gamma", 1.00, 3.00)]
_PRICES_SQL = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)
_USAGE_SQL = f"""{_RES}, usage AS (SELECT dataset, model, n AS n_test, accuracy, macro_f1, n * 700 AS prompt_tok,
    n * 3 AS completion_tok, n * 0.25::DOUBLE AS wall_s FROM res WHERE seed = 42),
  price AS (SELECT * FROM (VALUES {_PRICES_SQL}) p(model, price_in, price_out)),
  priced AS (SELECT * FROM usage LEFT JOIN price USING (model)),
  costs AS (SELECT *, (prompt_tok + completion_tok) / greatest(1, n_test) AS tok_per_sample,
    wall_s / greatest(1, n_test) AS lat_per_sample_s,
    (prompt_tok * price_in + completion_tok * price_out) / 1e6 AS cost_usd,
    (prompt_tok * price_in + completion_tok * price_out) / 1e6 / greatest(1.0::DOUBLE, accuracy * n_test) AS cost_per_correct_usd
  FROM priced)"""


def usage(spark, sf):
    prices = spark.createDataFrame(_PRICES, "model string, price_in double, price_out double")
    used = results(spark, sf).where("seed = 42").select(
        "dataset",
        "model",
        F.col("n").alias("n_test"),
        "accuracy",
        "macro_f1",
        (F.col("n") * 700).alias("prompt_tok"),
        (F.col("n") * 3).alias("completion_tok"),
        (F.col("n") * 0.25).alias("wall_s"),
    )
    return ensembles.rate_lookup(used, prices)


@query(
    "rate_lookup",
    f"{_USAGE_SQL} SELECT dataset, model, prompt_tok, price_in, price_out FROM priced",
)
def rate_lookup(spark, sf):
    return usage(spark, sf).select("dataset", "model", "prompt_tok", "price_in", "price_out")


_COST_OUT = ["tok_per_sample", "lat_per_sample_s", "cost_usd", "cost_per_correct_usd"]


@query(
    "cost_table",
    f"{_USAGE_SQL} SELECT dataset, model, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in _COST_OUT)
    + " FROM costs",
)
def cost_table(spark, sf):
    costs = reports.cost_table(usage(spark, sf)).select("dataset", "model", *_COST_OUT)
    return rounded(costs, _COST_OUT)


@query(
    "cost_repricing",
    f"""{_USAGE_SQL} SELECT dataset, model, n_test, round(prompt_tok / 1e6 * price_in * 2 + completion_tok / 1e6 * price_out, 9) AS cost_usd_new,
      round((prompt_tok / 1e6 * price_in * 2 + completion_tok / 1e6 * price_out) / (accuracy * n_test), 9) AS cost_per_correct_usd_new,
      abs(prompt_tok / 1e6 * price_in) > 1e-5 AS price_changed FROM costs WHERE price_in IS NOT NULL""",
)
def cost_repricing(spark, sf):
    old = reports.cost_table(usage(spark, sf)).where("price_in IS NOT NULL").drop("n_test")
    new = reports.reprice(old.withColumn("price_in", F.col("price_in") * 2))
    columns = ["cost_usd_new", "cost_per_correct_usd_new"]
    return rounded(new.select("dataset", "model", "n_test", *columns, "price_changed"), columns)


@query(
    "cheapest_and_dearest",
    f"""{_USAGE_SQL} SELECT dataset, arg_min(model, cost_per_correct_usd) AS cheapest,
      arg_max(model, cost_per_correct_usd) AS dearest,
      round(max(cost_per_correct_usd) / min(cost_per_correct_usd), 6) AS ratio FROM costs
    WHERE cost_per_correct_usd IS NOT NULL GROUP BY dataset""",
)
def cheapest_and_dearest(spark, sf):
    costs = reports.cost_table(usage(spark, sf)).where("cost_per_correct_usd IS NOT NULL")
    return rounded(reports.price_spread(costs, "cost_per_correct_usd", ["dataset"]), ["ratio"], 6)


@query(
    "pareto_cost_f1",
    f"""{_USAGE_SQL} SELECT dataset, model, round(cost_per_correct_usd, 9) AS cost, macro_f1 FROM costs
    WHERE cost_per_correct_usd IS NOT NULL
    QUALIFY macro_f1 > coalesce(max(macro_f1) OVER (PARTITION BY dataset ORDER BY cost_per_correct_usd, macro_f1 DESC, model
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)""",
)
def pareto_cost_f1(spark, sf):
    costs = reports.cost_table(usage(spark, sf))
    front = reports.pareto_frontier(costs, "cost_per_correct_usd", "macro_f1", ["dataset"])
    return front.select(
        "dataset", "model", F.round("cost_per_correct_usd", 9).alias("cost"), "macro_f1"
    )


@query(
    "arm_delta",
    f"""{_RES} SELECT dataset, model, """
    + ", ".join(
        f"round(round(avg({m}) FILTER (seed = 44), 9) - round(avg({m}) FILTER (seed = 42), 9), 4) AS delta_{m}"
        for m in SHOWN
    )
    + " FROM res GROUP BY dataset, model",
)
def arm_delta(spark, sf):
    arms = results(spark, sf).withColumn("regime", F.col("seed").cast("string"))
    return reports.arm_delta(arms, ["dataset", "model"], "regime", "42", "44", SHOWN)


@query(
    "mean_and_spread",
    f"{_RES} SELECT dataset, kind, "
    + ", ".join(
        f"round(avg({m}), 8) AS {m}_mean, round(stddev_samp({m}), 8) AS {m}_std" for m in SHOWN
    )
    + " FROM res GROUP BY dataset, kind",
)
def mean_and_spread(spark, sf):
    spread = reports.mean_and_spread(results(spark, sf), ["dataset", "kind"], SHOWN)
    return rounded(spread, [f"{m}_{s}" for m in SHOWN for s in ("mean", "std")], 8)


@query(
    "shot_curve",
    f"{_RES} SELECT model, (seed - 41) AS k, "
    + ", ".join(f"round(avg({m}), 8) AS {m}_mean, round(stddev_pop({m}), 8) AS {m}_std" for m in SHOWN)
    + ", count(*) AS n_runs FROM res GROUP BY model, seed",
)
def shot_curve(spark, sf):
    stepped = results(spark, sf).withColumn("k", F.col("seed") - 41)
    curve = reports.metric_curve(stepped, ["model"], "k", SHOWN)
    return rounded(curve, [f"{m}_{s}" for m in SHOWN for s in ("mean", "std")], 8)


@query(
    "feature_budget_curve",
    f"""{_RES}, b AS (SELECT dataset, model, CASE seed WHEN 42 THEN '6' WHEN 43 THEN '12' ELSE 'all' END AS k_feat, mcc FROM res)
    SELECT dataset, model, k_feat, round(avg(mcc), 8) AS mcc,
      CAST(list_position(['6', '8', '10', '12', '16', '20', 'all'], k_feat) AS INTEGER) AS step_order
    FROM b GROUP BY ALL""",
)
def feature_budget_curve(spark, sf):
    k = F.when(F.col("seed") == 42, "6").when(F.col("seed") == 43, "12").otherwise("all")
    order = ["6", "8", "10", "12", "16", "20", "all"]
    rows = results(spark, sf).withColumn("k_feat", k)
    return rounded(reports.budget_curve(rows, ["dataset", "model"], "k_feat", order, "mcc"), ["mcc"], 8)


_NAMES = [m for m, _, _ in MODELS]


@query(
    "unseen_class_recall",
    f"""WITH {DETECTIONS_SQL}, r AS (SELECT y_true AS heldout, model,
      avg(CASE WHEN y_pred <> 'Normal' THEN 1 ELSE 0 END) AS recall FROM det WHERE y_true <> 'Normal' GROUP BY ALL)
    SELECT heldout, """
    + ", ".join(f"round(max(recall) FILTER (model = '{m}'), 9) AS {m}" for m in _NAMES)
    + " FROM r GROUP BY heldout",
)
def unseen_class_recall(spark, sf):
    detected = F.coalesce((F.col("y_pred") != "Normal").cast("int"), F.lit(0))
    recall = (
        detections(spark, sf)
        .where("y_true <> 'Normal'")
        .groupBy(F.col("y_true").alias("heldout"), "model")
        .agg(F.round(F.avg(detected), 9).alias("recall"))
    )
    return reports.wide_table(recall, ["heldout"], "model", _NAMES, ["recall"])


@query(
    "model_comparison",
    f"""{_RES}, runs AS (SELECT model, accuracy, macro_f1, NULL AS error FROM res
      UNION ALL SELECT DISTINCT 'broken', NULL::DOUBLE, NULL::DOUBLE, 'fit failed' FROM res)
    SELECT model, CAST(printf('%.4f', avg(accuracy)) AS DOUBLE) AS accuracy, CAST(printf('%.4f', avg(macro_f1)) AS DOUBLE) AS macro_f1,
      count(*) FILTER (error IS NULL) AS n_runs,
      CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN min(error) END AS error FROM runs GROUP BY model""",
)
def model_comparison(spark, sf):
    good = results(spark, sf).select("model", "accuracy", "macro_f1").withColumn(
        "error", F.lit(None).cast("string")
    )
    failed = good.select(F.lit("broken").alias("model"), F.lit("fit failed").alias("error")).distinct()
    runs = good.unionByName(failed, allowMissingColumns=True)
    compared = reports.model_comparison(runs, ["accuracy", "macro_f1"])
    return compared.withColumns(
        {m: mean_from_text(F.col(m)) for m in ("accuracy", "macro_f1")}
    )


RARE = 200


@query(
    "rare_class_summary",
    f"""{_RES}, rare AS (SELECT dataset, model, kind, seed, y_true FROM conf GROUP BY ALL
      HAVING sum(n) < {RARE} AND y_true <> 'Normal'),
    s AS (SELECT dataset, model, kind, seed, sum(n)::BIGINT AS n_rare,
        round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n), 9) AS rare_accuracy
      FROM conf JOIN rare USING (dataset, model, kind, seed, y_true) GROUP BY ALL)
    SELECT dataset, model, kind, seed, macro_f1 AS overall_f1_macro, n_rare, rare_accuracy
    FROM res LEFT JOIN s USING (dataset, model, kind, seed)""",
)
def rare_class_summary(spark, sf):
    counts = scoring.confusion_counts(detections(spark, sf), RUN)
    overall = rounded(scoring.detection_metrics(counts, RUN), ["macro_f1"])
    rare = scoring.rare_class_metrics(counts, RUN, RARE).select(*RUN, "n_rare", "rare_accuracy")
    return rounded(reports.rare_summary(overall, rare, RUN), ["rare_accuracy"])


@query(
    "order_by_overall_mean",
    f"{_RES} SELECT model, round(avg(macro_f1), 8) AS macro_f1 FROM res GROUP BY model ORDER BY 2 DESC",
)
def order_by_overall_mean(spark, sf):
    return rounded(reports.by_overall_mean(results(spark, sf), ["model"], "macro_f1"), ["macro_f1"], 8)


@query("distinct_inputs", "SELECT DISTINCT source AS path FROM documents")
def distinct_inputs(spark, sf):
    from gridvigil.plans.registry import table

    paths = table(spark, sf, "documents").select(F.col("source").alias("path"))
    return reports.distinct_inputs(paths)
