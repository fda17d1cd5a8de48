"""Registered queries for samples, splits and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.operators import sampling
from gridvigil.plans.detections import ORDERS_SQL, labelled_orders, rounded
from gridvigil.plans.registry import query, table

SEEDS = (42, 43, 44)


def _events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "value",
        F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("label"),
    )


_EVENTS_SQL = """ev AS (SELECT event_id, value,
  CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END AS label FROM events)"""
_SEEDED_SQL = f"""{_EVENTS_SQL}, s AS (SELECT ev.*, seed,
    row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat(seed, ':', event_id))) AS rn
  FROM ev, (VALUES (42), (43), (44)) v(seed))"""
_ORDER_RANK_SQL = f"""{ORDERS_SQL}, r AS (SELECT row_id, y_true, o_totalprice,
    row_number() OVER (PARTITION BY y_true ORDER BY md5(concat('42:', row_id))) AS rn,
    row_number() OVER (ORDER BY md5(concat('42:', row_id))) AS all_rn,
    count(*) OVER (PARTITION BY y_true) AS nc, count(*) OVER () AS n FROM lab),
  c AS (SELECT y_true, count(*) AS n FROM lab GROUP BY ALL)"""


@query(
    "k_per_class",
    f"WITH {_SEEDED_SQL} SELECT seed, label, event_id, value FROM s WHERE rn <= 25",
)
def k_per_class(spark, sf):
    rows = sampling.per_class(_events(spark, sf), "label", 25, ["event_id"], SEEDS)
    return rows.select("seed", "label", "event_id", "value")


@query(
    "k_per_class_large",
    f"WITH {_SEEDED_SQL} SELECT seed, label, event_id, value FROM s WHERE rn <= 1500",
)
def k_per_class_large(spark, sf):
    rows = sampling.per_class(_events(spark, sf), "label", 1500, ["event_id"], SEEDS)
    return rows.select("seed", "label", "event_id", "value")


@query(
    "shot_and_test_split",
    f"""WITH {_SEEDED_SQL} SELECT seed, label, event_id,
      CASE WHEN rn <= 10 THEN 'shot' ELSE 'test' END AS part FROM s WHERE rn <= 60""",
)
def shot_and_test_split(spark, sf):
    rows = sampling.shot_and_test(_events(spark, sf), "label", 10, 50, ["event_id"], SEEDS)
    return rows.select("seed", "label", "event_id", "part")


@query(
    "stratified_split",
    f"""WITH {_ORDER_RANK_SQL},
    t AS (SELECT y_true, n, sum(n) OVER () AS al, sum(n) OVER () - ceil(sum(n) OVER () * 0.3::DOUBLE)::BIGINT AS tot FROM c),
    b AS (SELECT y_true, n, (n * tot) // al AS base, (n * tot) % al AS rest, tot FROM t),
    q AS (SELECT y_true, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y_true)
        <= tot - sum(base) OVER () THEN 1 ELSE 0 END AS target FROM b)
    SELECT row_id, y_true, CASE WHEN rn <= target THEN 'train' ELSE 'test' END AS part FROM r JOIN q USING (y_true)""",
)
def stratified_split(spark, sf):
    rows = sampling.stratified_split(labelled_orders(spark, sf), "y_true", ["row_id"])
    return rows.select("row_id", "y_true", "part")


@query(
    "unstratified_split",
    f"""WITH {_ORDER_RANK_SQL} SELECT row_id, y_true,
      CASE WHEN all_rn <= n - ceil(n * 0.3::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def unstratified_split(spark, sf):
    rows = sampling.stratified_split(
        labelled_orders(spark, sf), "y_true", ["row_id"], stratify=False
    )
    return rows.select("row_id", "y_true", "part")


@query(
    "pool_and_holdout",
    f"""WITH {_ORDER_RANK_SQL} SELECT row_id, y_true,
      CASE WHEN rn <= round_even(nc * 0.2::DOUBLE, 0) THEN 'holdout' ELSE 'pool' END AS part FROM r""",
)
def pool_and_holdout(spark, sf):
    rows = sampling.pool_and_holdout(labelled_orders(spark, sf), "y_true", ["row_id"])
    return rows.select("row_id", "y_true", "part")


def _chrono_sql(tests: int | None) -> str:
    cap = "TRUE" if tests is None else f"t.late_rn <= {tests}"
    return f"""WITH {_EVENTS_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) AS pos,
        count(*) OVER (PARTITION BY label) AS n FROM ev),
    k AS (SELECT *, CASE WHEN n > 1 THEN least(greatest(20, round_even(n * 0.8::DOUBLE, 0)), n - 1)
        ELSE greatest(20, round_even(n * 0.8::DOUBLE, 0)) END AS cut FROM o),
    e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', event_id))) AS rn
        FROM k WHERE pos <= cut AND cut < n),
    t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) AS late_rn
        FROM k WHERE pos > cut AND cut > 0)
    SELECT event_id, label, 'shot' AS part FROM e WHERE rn <= 20
    UNION ALL SELECT event_id, label, 'test' FROM t WHERE {cap}"""


@query("chronological_split", _chrono_sql(100))
def chronological_split(spark, sf):
    rows = sampling.chronological_split(
        _events(spark, sf), "label", "event_id", ["event_id"], shots=20, tests=100
    )
    return rows.select("event_id", "label", "part")


@query("chronological_full_holdout", _chrono_sql(None))
def chronological_full_holdout(spark, sf):
    rows = sampling.chronological_split(
        _events(spark, sf), "label", "event_id", ["event_id"], shots=20
    )
    return rows.select("event_id", "label", "part")


@query("cap_random", f"WITH {_ORDER_RANK_SQL} SELECT row_id, y_true FROM r WHERE rn <= 2000")
def cap_random(spark, sf):
    rows = sampling.cap_per_class(labelled_orders(spark, sf), "y_true", 2000, ["row_id"])
    return rows.select("row_id", "y_true")


@query(
    "cap_earliest",
    f"""WITH {ORDERS_SQL} SELECT row_id, y_true FROM lab
    QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY row_id) <= 2000""",
)
def cap_earliest(spark, sf):
    rows = sampling.cap_per_class(labelled_orders(spark, sf), "y_true", 2000, order_col="row_id")
    return rows.select("row_id", "y_true")


def _prevalence_sql(size: str) -> str:
    return f"""t AS (SELECT y_true, n, round_even({size} * n / sum(n) OVER (), 0)::BIGINT AS raw FROM c),
    q AS (SELECT y_true, least(n, raw + CASE WHEN row_number() OVER (ORDER BY n DESC, y_true) = 1
      THEN {size} - sum(raw) OVER () ELSE 0 END) AS target FROM t)"""


@query(
    "prevalence_sample",
    f"""WITH {_ORDER_RANK_SQL}, {_prevalence_sql("1200")}
    SELECT row_id, y_true FROM r JOIN q USING (y_true) WHERE rn <= target""",
)
def prevalence_sample(spark, sf):
    rows = sampling.prevalence_sample(labelled_orders(spark, sf), "y_true", 1200, ["row_id"])
    return rows.select("row_id", "y_true")


@query(
    "balanced_sample",
    f"""WITH {_ORDER_RANK_SQL} SELECT row_id, y_true FROM r
    WHERE rn <= 601 // (SELECT count(*) FROM c)""",
)
def balanced_sample(spark, sf):
    rows = sampling.balanced_sample(labelled_orders(spark, sf), "y_true", 601, ["row_id"])
    return rows.select("row_id", "y_true")


@query(
    "proportional_sample",
    f"""WITH {_ORDER_RANK_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY all_rn) AS pick FROM r
      WHERE rn <= least(nc, greatest(1, round_even(33 * nc / n, 0))))
    SELECT row_id, y_true FROM p WHERE pick <= 33""",
)
def proportional_sample(spark, sf):
    rows = sampling.proportional_sample(labelled_orders(spark, sf), "y_true", 33, ["row_id"])
    return rows.select("row_id", "y_true")


@query(
    "uniform_sample",
    f"WITH {_ORDER_RANK_SQL} SELECT row_id, y_true, o_totalprice FROM r WHERE all_rn <= 5000",
)
def uniform_sample(spark, sf):
    rows = sampling.uniform_sample(labelled_orders(spark, sf), 5000, ["row_id"])
    return rows.select("row_id", "y_true", "o_totalprice")


@query(
    "leave_one_class_out",
    f"""WITH {_ORDER_RANK_SQL},
    f AS (SELECT r.*, rn <= CASE WHEN y_true = 'Normal' THEN 4000 ELSE 2000 END AS tst, h.heldout
      FROM r, (SELECT y_true AS heldout FROM c WHERE y_true <> 'Normal') h)
    SELECT heldout, row_id, y_true, CASE WHEN y_true = 'Normal' THEN 'Normal' ELSE 'Attack' END AS target,
      'train' AS part FROM f WHERE y_true <> heldout AND NOT (y_true = 'Normal' AND tst)
    UNION ALL SELECT heldout, row_id, y_true,
      CASE WHEN y_true = 'Normal' THEN 'Normal' ELSE 'Attack' END, 'test'
      FROM f WHERE tst AND (y_true = 'Normal' OR y_true = heldout)""",
)
def leave_one_class_out(spark, sf):
    rows = sampling.leave_one_class_out(labelled_orders(spark, sf), "y_true", ["row_id"])
    return rows.select("heldout", "row_id", "y_true", "target", "part")


@query(
    "seeded_shuffle",
    """SELECT event_id, md5(concat('7:', event_id)) AS digest,
    CAST('0x' || substr(md5(concat('7:', event_id)), 1, 15) AS BIGINT) AS draw FROM events""",
)
def seeded_shuffle(spark, sf):
    drawn = sampling.with_draw(table(spark, sf, "events"), ["event_id"], 7)
    return drawn.select("event_id", "digest", "draw")


_BUDGETS = [("small", 1000), ("large", 5000), ("whole", None)]


@query(
    "training_budgets",
    f"""WITH {ORDERS_SQL}, v AS (SELECT * FROM (VALUES (42), (43)) v(seed)),
    m AS (SELECT * FROM (VALUES ('small', 1000), ('large', 5000), ('whole', NULL)) m(model, budget)),
    c AS (SELECT y_true, count(*) AS n, sum(count(*)) OVER () AS al FROM lab GROUP BY y_true),
    t AS (SELECT model, y_true, n, least(coalesce(budget, al), al) AS lim,
      round_even(least(coalesce(budget, al), al) * n / al, 0)::BIGINT AS raw FROM c, m),
    q AS (SELECT model, y_true, least(n, raw + CASE WHEN row_number() OVER
        (PARTITION BY model ORDER BY n DESC, y_true) = 1
        THEN lim - sum(raw) OVER (PARTITION BY model) ELSE 0 END) AS target FROM t),
    r AS (SELECT seed, row_id, y_true, row_number() OVER
        (PARTITION BY seed, y_true ORDER BY md5(concat(seed, ':', row_id))) AS rn FROM lab, v)
    SELECT model, seed, row_id, y_true FROM r JOIN q USING (y_true) WHERE rn <= target""",
)
def training_budgets(spark, sf):
    budgets = spark.createDataFrame(_BUDGETS, "model string, budget long")
    rows = sampling.budget_samples(
        labelled_orders(spark, sf), "y_true", budgets, ["row_id"], seeds=(42, 43)
    )
    return rows.select("model", "seed", "row_id", "y_true")


@query(
    "class_weights",
    f"""WITH {_ORDER_RANK_SQL}
    SELECT y_true, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c""",
)
def class_weights(spark, sf):
    return rounded(sampling.class_weights(labelled_orders(spark, sf), "y_true"), ["weight"])


@query(
    "class_weight_column",
    f"""WITH {_ORDER_RANK_SQL}, w AS (SELECT y_true, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
    SELECT row_id, y_true, round(weight, 9) AS weight FROM lab JOIN w USING (y_true)""",
)
def class_weight_column(spark, sf):
    weighted = sampling.with_class_weight(labelled_orders(spark, sf), "y_true")
    return rounded(weighted.select("row_id", "y_true", "weight"), ["weight"])


@query(
    "positive_weight",
    f"""WITH {ORDERS_SQL} SELECT dataset, round(count(*) FILTER (y_true = 'Normal')
      / greatest(1, count(*) FILTER (y_true <> 'Normal')), 9) AS pos_weight FROM lab GROUP BY dataset""",
)
def positive_weight(spark, sf):
    weights = sampling.positive_weight(labelled_orders(spark, sf), "y_true", ["dataset"])
    return rounded(weights, ["pos_weight"])
