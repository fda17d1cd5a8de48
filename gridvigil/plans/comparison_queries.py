"""Registered queries for uncertainty, tests, and combined detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.operators import comparison, ensembles, scoring
from gridvigil.plans.detections import (
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
_MET = f"WITH {DETECTIONS_SQL}, {metrics_sql(RUN_SQL)}"
_MELT = ", ".join(METRICS)


def run_metrics(spark, sf, run=RUN):
    counts = scoring.confusion_counts(detections(spark, sf), run)
    return scoring.detection_metrics(counts, run)


_LONG = f"""{_MET}, long AS (SELECT dataset, model, seed, metric, value FROM (
    UNPIVOT (SELECT {RUN_SQL}, {", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS)} FROM met)
    ON {_MELT} INTO NAME metric VALUE value))"""


@query(
    "run_aggregate",
    f"""{_LONG} SELECT dataset, model, metric, round(avg(value), 9) AS mean,
      round(stddev_pop(value), 9) AS std, count(*) AS n_runs FROM long GROUP BY ALL""",
)
def run_aggregate(spark, sf):
    result = comparison.run_aggregate(run_metrics(spark, sf), ["dataset", "model"], METRICS)
    return rounded(result, ["mean", "std"])


@query(
    "seed_aggregate",
    f"""{_LONG} SELECT dataset, model, metric, round(avg(value), 9) AS mean, round(min(value), 9) AS "min",
      round(max(value), 9) AS "max", round(coalesce(stddev_samp(value), 0), 9) AS std, count(*) AS n_seeds
    FROM long GROUP BY dataset, model, metric""",
)
def seed_aggregate(spark, sf):
    result = comparison.seed_aggregate(run_metrics(spark, sf), ["dataset", "model"], METRICS)
    return rounded(result, ["mean", "min", "max", "std"])


@query(
    "wilson_intervals",
    f"""WITH {DETECTIONS_SQL}, {metrics_sql(RUN_SQL)},
    r AS (SELECT {RUN_SQL}, 'accuracy' AS rate, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS k, sum(n) AS n
        FROM conf GROUP BY ALL
      UNION ALL SELECT {RUN_SQL}, 'far', sum(CASE WHEN y_pred <> 'Normal' THEN n ELSE 0 END), sum(n)
        FROM conf WHERE y_true = 'Normal' GROUP BY ALL
      UNION ALL SELECT {RUN_SQL}, 'dr', sum(CASE WHEN y_pred <> 'Normal' THEN n ELSE 0 END), sum(n)
        FROM conf WHERE y_true <> 'Normal' GROUP BY ALL),
    z AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM r)
    SELECT {RUN_SQL}, rate, k::BIGINT AS k, n::BIGINT AS n, round(p, 9) AS share,
      round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS lo,
      round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS hi FROM z""",
)
def wilson_intervals(spark, sf):
    counts = scoring.confusion_counts(detections(spark, sf), RUN)
    return rounded(comparison.rate_intervals(counts, RUN), ["share", "lo", "hi"])


def _bootstrap_sql(source: str, keys: str, value: str, order: str, resamples: int) -> str:
    return f"""bx AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS spot,
      count(*) OVER (PARTITION BY {keys}) AS bn FROM {source} WHERE {value} IS NOT NULL),
    bs AS (SELECT {keys}, first(bn) AS bn, avg(x) AS mean FROM bx GROUP BY {keys}),
    bd AS (SELECT {keys}, b, CAST('0x' || substr(md5(concat('0:', b, ':', d)), 1, 15) AS BIGINT) % bn AS spot
      FROM bs, range({resamples}) rb(b), LATERAL (SELECT unnest(range(bn)) AS d)),
    bm AS (SELECT {keys}, b, avg(x) AS m FROM bd JOIN bx USING ({keys}, spot) GROUP BY {keys}, b),
    boot AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY {keys})"""


@query(
    "bootstrap_interval",
    f"""{_MET}, {_bootstrap_sql("met", "dataset, model", "macro_f1", "seed", 1000)}
    SELECT dataset, model, round(mean, 9) AS mean, bn AS n, round(lo, 9) AS lo, round(hi, 9) AS hi
    FROM bs JOIN boot USING (dataset, model)""",
)
def bootstrap_interval(spark, sf):
    result = comparison.bootstrap_interval(
        run_metrics(spark, sf), ["dataset", "model"], "macro_f1", "seed", 1000
    )
    return rounded(result, ["mean", "lo", "hi"])


#: erfc by Simpson's rule on [x, x + 8] with 8000 steps
def erfc_sql(x: str) -> str:
    return f"""(SELECT sum(CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-pow({x} + i * 0.001::DOUBLE, 2))) * 0.001::DOUBLE / 3 * 2 / sqrt(pi()) FROM range(8001) t(i))"""


_PAIR_SQL = f"""{DETECTIONS_SQL},
pairs AS (SELECT a.dataset, a.seed, a.row_id, a.y_true, a.y_pred AS a_y_pred, b.y_pred AS b_y_pred,
    a.conf AS a_conf, b.conf AS b_conf
  FROM det a JOIN det b ON a.model = 'beta' AND b.model = 'gamma'
    AND a.dataset = b.dataset AND a.seed = b.seed AND a.row_id = b.row_id)"""
PAIR_KEYS = ["dataset", "seed", "row_id"]


def beta_gamma(spark, sf):
    return comparison.paired_predictions(
        detections(spark, sf), PAIR_KEYS, "beta", "gamma", ["y_pred", "conf"]
    )


@query(
    "paired_predictions",
    f"""WITH {DETECTIONS_SQL} SELECT dataset, seed, row_id, max(y_true) AS y_true,
      max(CASE WHEN model = 'beta' THEN y_pred END) AS a_y_pred, max(CASE WHEN model = 'gamma' THEN y_pred END) AS b_y_pred,
      max(CASE WHEN model = 'beta' THEN conf END) AS a_conf, max(CASE WHEN model = 'gamma' THEN conf END) AS b_conf
    FROM det WHERE model IN ('beta', 'gamma') GROUP BY dataset, seed, row_id""",
)
def paired_predictions(spark, sf):
    return beta_gamma(spark, sf)


_COUNT_SQL = """counted AS (SELECT dataset, seed, y_true AS "class", count(*) AS n,
    avg(CASE WHEN a_y_pred = y_true THEN 1 ELSE 0 END) AS acc_a,
    avg(CASE WHEN b_y_pred = y_true THEN 1 ELSE 0 END) AS acc_b,
    avg(CASE WHEN a_y_pred IS NOT DISTINCT FROM b_y_pred THEN 1 ELSE 0 END) AS agreement,
    count(*) FILTER (a_y_pred = y_true AND coalesce(b_y_pred, '') <> y_true) AS b,
    count(*) FILTER (b_y_pred = y_true AND coalesce(a_y_pred, '') <> y_true) AS c
  FROM pairs GROUP BY ALL)"""


@query(
    "mcnemar_test",
    f"""WITH {_PAIR_SQL}, {_COUNT_SQL}
    SELECT dataset, seed, "class", n, round(acc_a, 9) AS acc_a, round(acc_b, 9) AS acc_b,
      round(acc_a - acc_b, 9) AS delta_acc, round(agreement, 9) AS agreement, b, c,
      CASE WHEN b + c = 0 THEN NULL
        WHEN b + c < 25 THEN round(least(1, (SELECT sum(gamma(b + c + 1) / (gamma(i + 1) * gamma(b + c - i + 1)))
          FROM range(25) t(i) WHERE i <= least(b, c)) * 2 / pow(2::DOUBLE, b + c)) + 1e-13, 7)
        ELSE round({erfc_sql("sqrt(pow(abs(b - c) - 1, 2) / (b + c) / 2)")}, 7) END AS p
    FROM counted""",
)
def mcnemar_test(spark, sf):
    pairs = beta_gamma(spark, sf).withColumn("class", F.col("y_true"))
    result = comparison.mcnemar(pairs, ["dataset", "seed", "class"])
    return rounded(rounded(result, ["acc_a", "acc_b", "delta_acc", "agreement"]), ["p"], 7)


_ROUTE_SQL = """routed AS (SELECT *, coalesce(a_y_pred IN ('Backdoor', 'CommInj'), FALSE) AS asked,
  CASE WHEN coalesce(a_y_pred IN ('Backdoor', 'CommInj'), FALSE) THEN b_y_pred ELSE a_y_pred END AS y_pred FROM pairs)"""


@query(
    "predicted_class_router",
    f"""WITH {_PAIR_SQL}, {_ROUTE_SQL}, {metrics_sql("dataset, seed", "routed", "true")},
    q AS (SELECT dataset, seed, avg(CASE WHEN asked THEN 1 ELSE 0 END) AS asked_share FROM routed GROUP BY ALL)
    SELECT dataset, seed, n, round(asked_share, 9) AS asked_share, {rounded_sql(METRICS)}
    FROM met JOIN q USING (dataset, seed)""",
)
def predicted_class_router(spark, sf):
    routed = ensembles.route_by_prediction(beta_gamma(spark, sf), ["Backdoor", "CommInj"])
    result = ensembles.combined_metrics(routed, ["dataset", "seed"])
    return rounded(result, ["asked_share", *METRICS])


_TAUS_SQL = ", ".join(f"({t}::DOUBLE)" for t in ensembles.TAUS)


@query(
    "confidence_cascade",
    f"""WITH {_PAIR_SQL}, swept AS (SELECT *, a_conf < tau AS asked,
      CASE WHEN a_conf < tau THEN b_y_pred ELSE a_y_pred END AS y_pred FROM pairs, (VALUES {_TAUS_SQL}) t(tau)),
    {metrics_sql("dataset, seed, tau", "swept", "true")},
    q AS (SELECT dataset, seed, tau, avg(CASE WHEN asked THEN 1 ELSE 0 END) AS asked_share FROM swept GROUP BY ALL)
    SELECT dataset, seed, tau, n, round(asked_share, 9) AS asked_share, {rounded_sql(METRICS)}
    FROM met JOIN q USING (dataset, seed, tau)""",
)
def confidence_cascade(spark, sf):
    swept = ensembles.cascade(beta_gamma(spark, sf))
    result = ensembles.combined_metrics(swept, ["dataset", "seed", "tau"])
    return rounded(result, ["asked_share", *METRICS])


@query(
    "oracle_router",
    f"""WITH {_PAIR_SQL}, {metrics_sql(RUN_SQL)},
    pick AS (SELECT dataset, class AS y_true, CASE WHEN avg(f1) FILTER (model = 'beta')
        >= avg(f1) FILTER (model = 'gamma') THEN 'beta' ELSE 'gamma' END AS winner
      FROM cls WHERE support > 0 AND model IN ('beta', 'gamma') GROUP BY dataset, class),
    routed AS (SELECT dataset, seed, y_true, CASE WHEN winner = 'beta' THEN a_y_pred ELSE b_y_pred END AS y_pred
      FROM pairs LEFT JOIN pick USING (dataset, y_true))
    SELECT dataset, seed, y_true, coalesce(y_pred, '<NONE>') AS y_pred, count(*) AS n FROM routed GROUP BY ALL""",
)
def oracle_router(spark, sf):
    predictions = detections(spark, sf).where(F.col("model").isin("beta", "gamma"))
    choice = ensembles.oracle_choice(predictions, ["dataset"], "beta", "gamma")
    routed = ensembles.oracle_route(beta_gamma(spark, sf), choice, ["dataset"], "beta")
    return scoring.confusion_counts(routed, ["dataset", "seed"])


@query(
    "majority_vote",
    f"""WITH {DETECTIONS_SQL},
    b AS (SELECT seed, row_id, y_pred, count(*) AS votes, min(model) AS seen FROM det
      WHERE y_pred IS NOT NULL GROUP BY ALL),
    k AS (SELECT DISTINCT seed, row_id FROM det),
    w AS (SELECT seed, row_id, y_pred AS vote, votes FROM b
      QUALIFY row_number() OVER (PARTITION BY seed, row_id ORDER BY votes DESC, seen) = 1)
    SELECT seed, row_id, vote FROM k LEFT JOIN w USING (seed, row_id)""",
)
def majority_vote(spark, sf):
    ballots = detections(spark, sf).groupBy("seed", "row_id").agg(
        F.sort_array(F.collect_list(F.struct("model", "y_pred"))).alias("ballots")
    )
    voted = ensembles.majority_vote(F.col("ballots.y_pred"))
    return ballots.select("seed", "row_id", voted.alias("vote"))


@query(
    "majority_vote_over_rows",
    f"""WITH {DETECTIONS_SQL},
    b AS (SELECT dataset, seed, y_true, y_pred, count(*) AS votes, min(row_id) AS seen FROM det
      WHERE y_pred IS NOT NULL GROUP BY ALL)
    SELECT dataset, seed, y_true, y_pred, votes FROM b
    QUALIFY row_number() OVER (PARTITION BY dataset, seed, y_true ORDER BY votes DESC, seen) = 1""",
)
def majority_vote_over_rows(spark, sf):
    return ensembles.vote_by_key(
        detections(spark, sf), ["dataset", "seed", "y_true"], "y_pred", "row_id"
    )


@query(
    "fallback_imputation",
    f"""WITH {DETECTIONS_SQL}, c AS (SELECT dataset, y_true, count(*) AS n FROM det WHERE y_true <> 'Normal' GROUP BY ALL),
    f AS (SELECT dataset, y_true AS fallback FROM c
      QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, y_true) = 1)
    SELECT dataset, model, seed, row_id, coalesce(y_pred, fallback) AS y_pred FROM det JOIN f USING (dataset)""",
)
def fallback_imputation(spark, sf):
    filled = ensembles.impute_unparsed(detections(spark, sf), ["dataset"])
    return filled.select("dataset", "model", "seed", "row_id", "y_pred")


@query(
    "minus_baseline",
    f"""{_MET}, a AS (SELECT dataset, model, avg(macro_f1) AS macro_f1, avg(mcc) AS mcc FROM met GROUP BY ALL)
    SELECT a.dataset, a.model, round(a.macro_f1, 9) AS macro_f1, round(a.mcc, 9) AS mcc,
      round(a.macro_f1 - r.macro_f1, 9) AS delta_macro_f1, round(a.mcc - r.mcc, 9) AS delta_mcc
    FROM a LEFT JOIN a r ON r.model = 'alpha' AND r.dataset = a.dataset""",
)
def minus_baseline(spark, sf):
    means = run_metrics(spark, sf).groupBy("dataset", "model").agg(
        F.avg("macro_f1").alias("macro_f1"), F.avg("mcc").alias("mcc")
    )
    result = ensembles.minus_baseline(means, ["macro_f1", "mcc"], "alpha")
    return rounded(result, ["macro_f1", "mcc", "delta_macro_f1", "delta_mcc"])


@query(
    "best_model",
    f"""{_MET} SELECT dataset, model, round(macro_f1, 9) AS macro_f1 FROM met
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(macro_f1, 9) DESC, model) = 1""",
)
def best_model(spark, sf):
    results = rounded(run_metrics(spark, sf), ["macro_f1"])
    return ensembles.best_model(results, "macro_f1", ["dataset"])


@query(
    "top_models_forced_first",
    f"""{_MET}, s AS (SELECT dataset, model, round(max(macro_f1), 9) AS macro_f1 FROM met GROUP BY ALL)
    SELECT dataset, model, macro_f1, CAST(row_number() OVER w AS INTEGER) AS rank FROM s
    WINDOW w AS (PARTITION BY dataset ORDER BY CASE WHEN model = 'delta' THEN 0 ELSE 1 END, macro_f1 DESC, model)
    QUALIFY row_number() OVER w <= 3""",
)
def top_models_forced_first(spark, sf):
    results = rounded(run_metrics(spark, sf), ["macro_f1"])
    return ensembles.top_models(results, "macro_f1", 3, "delta", ["dataset"])


_DAILY_SQL = """daily AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'alpha' WHEN l_returnflag = 'R' THEN 'beta'
    ELSE 'gamma' END AS model, l_linestatus AS dataset, year(l_shipdate) AS seed, round(avg(l_discount), 4) AS f1
  FROM lineitem GROUP BY ALL)"""


def yearly_scores(spark, sf):
    """One value per (data set, model, year), as if each year were a run."""
    model = (
        F.when(F.col("l_returnflag") == "A", "alpha")
        .when(F.col("l_returnflag") == "R", "beta")
        .otherwise("gamma")
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_linestatus").alias("dataset"),
            model.alias("model"),
            F.year("l_shipdate").alias("seed"),
        )
        .agg(F.round(F.avg("l_discount"), 4).alias("f1"))
    )


_U_SQL = f"""{_DAILY_SQL},
sides AS (SELECT a.dataset, a.model, a.f1, 1 AS own FROM daily a WHERE model <> 'alpha'
  UNION ALL SELECT r.dataset, m.model, r.f1, 0 FROM daily r, (VALUES ('beta'), ('gamma')) m(model) WHERE r.model = 'alpha'),
vals AS (SELECT dataset, model, f1, sum(own) AS pos, sum(1 - own) AS neg FROM sides GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dataset, model ORDER BY f1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
us AS (SELECT dataset, model, sum(pos * (below + neg / 2)) AS u, sum(pos)::BIGINT AS n_model, sum(neg)::BIGINT AS n_reference,
  sum(pow(pos + neg, 3) - (pos + neg)) AS tie_term FROM cum GROUP BY ALL)"""


@query(
    "rank_sum_u",
    f"""WITH {_U_SQL} SELECT dataset, model, u::DOUBLE AS u, n_model, n_reference, tie_term::DOUBLE AS tie_term FROM us""",
)
def rank_sum_u(spark, sf):
    return comparison.rank_sum(yearly_scores(spark, sf), ["dataset"], "f1", "alpha").drop("p")


@query(
    "rank_sum_test",
    f"""WITH {_U_SQL}, z AS (SELECT *, (greatest(u, n_model * n_reference - u) - n_model * n_reference / 2 - 0.5) / sqrt(
        n_model * n_reference / 12 * ((n_model + n_reference + 1)
          - tie_term / ((n_model + n_reference) * (n_model + n_reference - 1)))) AS zz FROM us)
    SELECT dataset, model, u::DOUBLE AS u, n_model, n_reference, tie_term::DOUBLE AS tie_term,
      round(least(1, {erfc_sql("(zz / sqrt(2::DOUBLE))")}), 7) AS p FROM z""",
)
def rank_sum_test(spark, sf):
    result = comparison.rank_sum(yearly_scores(spark, sf), ["dataset"], "f1", "alpha")
    return rounded(result, ["p"], 7)


_CLS_SQL = f"""WITH {DETECTIONS_SQL}, {metrics_sql("model, seed")},
seen AS (SELECT model, seed, class AS cls, round(f1, 12) AS f1 FROM cls WHERE support > 0),
{_bootstrap_sql("seen", "model, cls", "f1", "seed", 500)}"""


@query(
    "class_f1_intervals",
    f"""{_CLS_SQL} SELECT model, cls AS "class", round(mean, 9) AS mean, bn AS n, round(lo, 9) AS lo,
      round(hi, 9) AS hi, round(mean - max(CASE WHEN model = 'alpha' THEN mean END) OVER (PARTITION BY cls), 9) AS delta
    FROM bs JOIN boot USING (model, cls)""",
)
def class_f1_intervals(spark, sf):
    run = ["model", "seed"]
    scores = scoring.class_scores(scoring.confusion_counts(detections(spark, sf), run), run)
    result = comparison.class_f1_comparison(scores, [], "alpha", 500).drop("p")
    return rounded(result, ["mean", "lo", "hi", "delta"])


#: two-sided p of U = 5 … 9 for three against three values without ties
_EXACT_3_3 = "CASE greatest(u, 9 - u) WHEN 9 THEN 0.1 WHEN 8 THEN 0.2 WHEN 7 THEN 0.4 WHEN 6 THEN 0.7 ELSE 1.0 END"
_ZZ = """((greatest(u, 9 - u) - 5) / sqrt(9 / 12 * (7 - tie_term / 30)) / sqrt(2::DOUBLE))"""


@query(
    "class_f1_comparison",
    f"""{_CLS_SQL},
    sides AS (SELECT cls, model, f1, 1 AS own FROM seen WHERE model <> 'alpha'
      UNION ALL SELECT r.cls, m.model, r.f1, 0 FROM seen r, (VALUES ('beta'), ('gamma'), ('delta')) m(model) WHERE r.model = 'alpha'),
    vals AS (SELECT cls, model, f1, sum(own) AS pos, sum(1 - own) AS neg FROM sides GROUP BY ALL),
    cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls, model ORDER BY f1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
    us AS (SELECT cls, model, sum(pos * (below + neg / 2)) AS u, sum(pow(pos + neg, 3) - (pos + neg)) AS tie_term FROM cum GROUP BY ALL),
    ps AS (SELECT cls, model, round(CASE WHEN tie_term = 0 THEN {_EXACT_3_3} ELSE least(1, {erfc_sql(_ZZ)}) END, 7)::DOUBLE AS p FROM us)
    SELECT model, cls AS "class", round(mean, 9) AS mean, bn AS n, round(lo, 9) AS lo, round(hi, 9) AS hi,
      round(mean - max(CASE WHEN model = 'alpha' THEN mean END) OVER (PARTITION BY cls), 9) AS delta, p
    FROM bs JOIN boot USING (model, cls) LEFT JOIN ps USING (model, cls)""",
)
def class_f1_comparison(spark, sf):
    run = ["model", "seed"]
    scores = scoring.class_scores(scoring.confusion_counts(detections(spark, sf), run), run)
    # values that differ only in the last bits are one value, as in the SQL
    scores = rounded(scores, ["f1"], 12)
    result = comparison.class_f1_comparison(scores, [], "alpha", 500)
    return rounded(rounded(result, ["mean", "lo", "hi", "delta"]), ["p"], 7)
