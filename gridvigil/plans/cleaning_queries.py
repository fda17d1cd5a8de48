"""Registered queries for cleaning, label and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.functions import labels, statistics
from gridvigil.operators import cleaning, ordering
from gridvigil.plans.detections import (
    DETECTIONS_SQL,
    detections,
    labelled_orders,
    ORDERS_SQL,
    rounded,
)
from gridvigil.plans.registry import query, table


def raw_telemetry(spark, sf):
    """events with text readings: bad text, gaps, infinities, a sparse and a fixed column."""
    e = table(spark, sf, "events")
    step = F.col("event_id") % 11
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    k = F.get_json_object("props", "$.k")
    missing = F.lit(None).cast("string")
    return e.select(
        "event_id",
        "user_id",
        F.when(step == 0, "bad")
        .when(step == 1, missing)
        .when(step == 2, "inf")
        .when(step == 3, "NaN")
        .otherwise(cents)
        .alias("level"),
        F.when(F.col("event_id") % 3 == 0, missing).otherwise(k).alias("flow"),
        F.when(F.col("event_id") % 5 == 0, k).alias("pit"),
        F.lit("7").alias("mv"),
        F.when(F.col("event_type") == "error", F.element_at(
            F.array(F.lit("A ttack"), F.lit(" Attack "), F.lit("A-ttack")),
            (F.col("event_id") % 3 + 1).cast("int")))
        .when(F.col("event_type") == "view", "normal")
        .otherwise(" Normal")
        .alias("raw_label"),
    )


_RAW_SQL = """raw AS (
  SELECT event_id, user_id,
    CASE event_id % 11 WHEN 0 THEN 'bad' WHEN 1 THEN NULL WHEN 2 THEN 'inf' WHEN 3 THEN 'NaN'
      ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS level,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS flow,
    CASE WHEN event_id % 5 = 0 THEN json_extract_string(props, '$.k') END AS pit,
    '7' AS mv,
    CASE WHEN event_type = 'error' THEN list_extract(['A ttack', ' Attack ', 'A-ttack'], CAST(event_id % 3 + 1 AS INT))
      WHEN event_type = 'view' THEN 'normal' ELSE ' Normal' END AS raw_label
  FROM events),
num AS (
  SELECT event_id, user_id, raw_label,
    CASE WHEN isfinite(try_cast(level AS DOUBLE)) THEN try_cast(level AS DOUBLE) END AS level,
    CASE WHEN isfinite(try_cast(flow AS DOUBLE)) THEN try_cast(flow AS DOUBLE) END AS flow,
    CASE WHEN isfinite(try_cast(pit AS DOUBLE)) THEN try_cast(pit AS DOUBLE) END AS pit,
    try_cast(mv AS DOUBLE) AS mv
  FROM raw)"""
FEATURES = ["level", "flow", "pit", "mv"]


def numeric_telemetry(spark, sf):
    return cleaning.to_numbers(raw_telemetry(spark, sf), FEATURES)


@query(
    "numeric_coercion",
    f"WITH {_RAW_SQL} SELECT event_id, level, flow, pit, mv FROM num",
)
def numeric_coercion(spark, sf):
    return numeric_telemetry(spark, sf).select("event_id", *FEATURES)


@query(
    "infinite_to_null",
    """SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 9 = 1 THEN NULL
      WHEN o_custkey % 9 = 2 THEN NULL ELSE o_totalprice END AS price FROM orders""",
)
def infinite_to_null(spark, sf):
    k = F.col("o_custkey") % 9
    holed = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k == 0, F.lit(float("inf")))
        .when(k == 1, F.lit(float("-inf")))
        .when(k == 2, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice"))
        .alias("price"),
    )
    return cleaning.to_numbers(holed, ["price"])


@query(
    "drop_rows_any_null",
    f"""WITH {_RAW_SQL} SELECT event_id, level, flow FROM num
    WHERE level IS NOT NULL AND flow IS NOT NULL""",
)
def drop_rows_any_null(spark, sf):
    return cleaning.drop_incomplete(
        numeric_telemetry(spark, sf).select("event_id", "level", "flow"), ["level", "flow"]
    )


@query(
    "drop_rows_all_null",
    f"""WITH {_RAW_SQL} SELECT event_id, level, flow FROM num
    WHERE level IS NOT NULL OR flow IS NOT NULL""",
)
def drop_rows_all_null(spark, sf):
    return cleaning.drop_incomplete(
        numeric_telemetry(spark, sf).select("event_id", "level", "flow"), ["level", "flow"], "all"
    )


@query(
    "drop_sparse_columns",
    f"WITH {_RAW_SQL} SELECT event_id, level, flow, mv FROM num",
)
def drop_sparse_columns(spark, sf):
    df = numeric_telemetry(spark, sf).select("event_id", *FEATURES)
    return cleaning.drop_sparse(df, FEATURES)


@query(
    "drop_constant_columns",
    f"WITH {_RAW_SQL} SELECT event_id, level, flow, pit FROM num",
)
def drop_constant_columns(spark, sf):
    df = numeric_telemetry(spark, sf).select("event_id", *FEATURES)
    return cleaning.drop_constant(df, FEATURES)


@query(
    "drop_repeated_rows",
    """SELECT l_quantity, l_discount, l_tax, l_returnflag, min(l_orderkey) AS l_orderkey
    FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag""",
)
def drop_repeated_rows(spark, sf):
    kept = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    rows = table(spark, sf, "lineitem").select(*kept, "l_orderkey")
    return cleaning.drop_repeats(rows, kept, "l_orderkey")


@query(
    "distinct_rows",
    "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem",
)
def distinct_rows(spark, sf):
    kept = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    return cleaning.drop_repeats(table(spark, sf, "lineitem").select(*kept), kept)


@query(
    "median_imputation",
    f"""WITH {_RAW_SQL}, m AS (SELECT median(level) AS ml, median(flow) AS mf, median(pit) AS mp FROM num)
    SELECT event_id, coalesce(level, ml, 0) AS level, coalesce(flow, mf, 0) AS flow,
      coalesce(pit, mp, 0) AS pit, CAST(0 AS DOUBLE) AS gone FROM num, m""",
)
def median_imputation(spark, sf):
    df = numeric_telemetry(spark, sf).select("event_id", "level", "flow", "pit")
    df = df.withColumn("gone", F.lit(None).cast("double"))
    return cleaning.impute_medians(df, ["level", "flow", "pit", "gone"])


@query(
    "narrow_types",
    """SELECT event_id::INTEGER AS event_id, user_id::INTEGER AS user_id,
      CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, event_id * 4000000000 AS big FROM events""",
)
def narrow_types(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", "user_id", "value", (F.col("event_id") * 4000000000).alias("big")
    )
    narrow = cleaning.narrow_types(df, ["event_id", "user_id", "value", "big"])
    return narrow.withColumn("value", F.col("value").cast("double"))


_NAMES = {
    "swat": ["LIT101", "FIT101", "AIT201", "PIT501", "DPIT301", "MV101", "P101", "UV401", "X"],
    "hai": ["P1_B2004", "P2_VT01", "P3_LIT01", "P4_ST_PO", "x1003"],
    "wustl": ["SrcPkts", "TotBytes", "SrcRate", "Dur", "sTtl", "TcpRtt", "Sport", "Proto", "Loss", "Mean"],
}
_GROUPS = {
    "swat": ["LIT", "FIT", "AIT", "PIT", "DPIT", "MV", "P", "UV", None],
    "hai": ["P1", "P2", "P3", "P4", "Other"],
    "wustl": [
        "Volume", "Volume", "Timing", "Timing", "TCP layer", "TCP layer", "Port/Proto",
        "Port/Proto", "Loss", "Other",
    ],
}


@query(
    "feature_groups",
    "WITH n AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, '{d}', '{f}', {'NULL' if g is None else repr(g)})"
        for d in _NAMES
        for i, (f, g) in enumerate(zip(_NAMES[d], _GROUPS[d]))
    )
    + """) v(i, dataset, feature, "group"))
    SELECT dataset, "group", count(*) AS n_rows FROM orders JOIN n
      ON (n.dataset = 'swat' AND o_custkey % 9 = i) OR (n.dataset = 'hai' AND o_custkey % 5 = i)
      OR (n.dataset = 'wustl' AND o_custkey % 10 = i)
    WHERE "group" IS NOT NULL GROUP BY ALL""",
)
def feature_groups(spark, sf):
    """Readings per feature group: every order stands for one reading of one sensor."""
    orders = table(spark, sf, "orders")
    rules = {
        "swat": cleaning.SWAT_GROUPS,
        "hai": cleaning.HAI_GROUPS,
        "wustl": cleaning.WUSTL_GROUPS,
    }
    parts = []
    for dataset, names in _NAMES.items():
        sensor = F.element_at(
            F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % len(names) + 1).cast("int")
        )
        readings = orders.select(sensor.alias("feature"))
        grouped = cleaning.feature_groups(readings, rules[dataset])
        parts.append(grouped.withColumn("dataset", F.lit(dataset)))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("dataset", "group").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "binary_label_detection",
    "SELECT doc_id, CASE WHEN toxic = 0 THEN 'Normal' ELSE 'Attack' END AS label FROM labels",
)
def binary_label_detection(spark, sf):
    docs = table(spark, sf, "labels")
    holder = docs.withColumn("kind", F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    name = cleaning.find_binary_label(holder, ["missing", "kind", "doc_id", "toxic", "quality"])
    return holder.select("doc_id", labels.truthy_label(F.col(name)).alias("label"))


@query(
    "categorical_label_detection",
    "SELECT o_orderkey, o_orderpriority AS label FROM orders",
)
def categorical_label_detection(spark, sf):
    orders = table(spark, sf, "orders").withColumn("flag", (F.col("o_custkey") % 2).cast("string"))
    name = cleaning.find_categorical_label(orders, ["missing", "flag", "o_orderpriority"])
    return orders.select("o_orderkey", F.col(name).alias("label"))


@query(
    "class_filter",
    f"WITH {ORDERS_SQL} SELECT row_id, y_true FROM lab WHERE y_true IN ('Backdoor', 'CommInj')",
)
def class_filter(spark, sf):
    rows = cleaning.keep_classes(labelled_orders(spark, sf), "y_true", ["Backdoor", "CommInj"])
    return rows.select("row_id", "y_true")


@query(
    "two_class_guard",
    f"WITH {ORDERS_SQL} SELECT y_true, count(*) AS n FROM lab GROUP BY y_true",
)
def two_class_guard(spark, sf):
    rows = cleaning.require_two_classes(labelled_orders(spark, sf), "y_true")
    return rows.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@query(
    "leakage_columns_dropped",
    "SELECT l_orderkey, l_quantity, l_tax FROM lineitem",
)
def leakage_columns_dropped(spark, sf):
    flows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_tax",
        F.col("l_shipdate").alias("StartTime"),
        F.col("l_suppkey").alias("SrcAddr"),
    )
    return cleaning.drop_leakage(flows)


@query(
    "label_map_passthrough",
    f"""WITH {_RAW_SQL} SELECT event_id, CASE trim(raw_label) WHEN 'A ttack' THEN 'Attack'
      ELSE trim(raw_label) END AS label FROM raw""",
)
def label_map_passthrough(spark, sf):
    mapped = labels.mapped_or_same(F.col("raw_label"), labels.SWAT_LABELS)
    return raw_telemetry(spark, sf).select("event_id", mapped.alias("label"))


@query(
    "label_letters_only",
    f"""WITH {_RAW_SQL} SELECT event_id,
      CASE WHEN lower(regexp_replace(raw_label, '[^A-Za-z]', '', 'g')) = 'normal' THEN 'Normal' ELSE 'Attack' END AS label
    FROM raw""",
)
def label_letters_only(spark, sf):
    clean = labels.letters_only(F.col("raw_label"), binary=True)
    return raw_telemetry(spark, sf).select("event_id", clean.alias("label"))


@query(
    "label_truthy_text",
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN 'Normal' ELSE 'Attack' END AS label FROM events""",
)
def label_truthy_text(spark, sf):
    texts = F.array(
        F.lit("0"), F.lit(" False "), F.lit(None).cast("string"), F.lit("0.0"), F.lit("1"), F.lit("True")
    )
    raw = F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", labels.truthy_label(raw).alias("label"))


@query(
    "label_any_indicator",
    """SELECT event_id, CASE WHEN event_id % 4 = 1 OR user_id % 5 = 2 OR event_id % 7 = 3
      THEN 'Attack' ELSE 'Normal' END AS label FROM events""",
)
def label_any_indicator(spark, sf):
    parts = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 1, "1").otherwise("0").alias("Attack_P1"),
        F.when(F.col("user_id") % 5 == 2, "2.0").otherwise("x").alias("Attack_P2"),
        F.when(F.col("event_id") % 7 == 3, "True").alias("Attack_P3"),
    )
    found = labels.any_indicator(["Attack_P1", "Attack_P2", "Attack_P3"])
    return parts.select("event_id", found.alias("label"))


_KINDS = [" DoS ", "RECONNAISSANCE", "mitm", "Denial-of-Service", "scan", "brute force"]


def _kind():
    return F.element_at(
        F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_custkey") % len(_KINDS) + 1).cast("int")
    )


def _kind_sql(values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"""SELECT o_orderkey, list_extract([{listed}], CAST(o_custkey % {len(values)} + 1 AS INT)) AS label FROM orders"""


@query(
    "label_map_title_default",
    _kind_sql(["DoS", "Reconnaissance", "MitM", "Denial-of-service", "Scan", "Brute Force"]),
)
def label_map_title_default(spark, sf):
    mapped = labels.mapped_or_title(_kind(), labels.WUSTL_LABELS)
    return table(spark, sf, "orders").select("o_orderkey", mapped.alias("label"))


@query(
    "label_five_classes",
    _kind_sql(["DoS", "Reconn", "mitm", "DoS", "Reconn", "brute force"]),
)
def label_five_classes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", labels.five_class(_kind()).alias("label"))


@query(
    "label_collapse",
    f"""WITH {ORDERS_SQL} SELECT row_id, CASE WHEN y_true = 'Normal' THEN 'Normal' ELSE 'Attack' END AS label FROM lab""",
)
def label_collapse(spark, sf):
    return labelled_orders(spark, sf).select("row_id", labels.collapsed(F.col("y_true")).alias("label"))


@query(
    "label_encode_decode",
    f"""WITH {ORDERS_SQL}, c AS (SELECT DISTINCT y_true FROM lab),
    k AS (SELECT y_true, CAST(row_number() OVER (ORDER BY y_true) - 1 AS INTEGER) AS code FROM c)
    SELECT row_id, code, y_true AS label FROM lab JOIN k USING (y_true)""",
)
def label_encode_decode(spark, sf):
    rows = labelled_orders(spark, sf)
    codes = ordering.class_codes(rows, "y_true")
    coded = rows.join(codes, "y_true").select("row_id", "code")
    return coded.join(codes, "code").select("row_id", "code", F.col("y_true").alias("label"))


@query(
    "many_class_codes",
    """WITH k AS (SELECT o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT o_totalprice FROM orders))
    SELECT o_orderkey, code FROM orders JOIN k USING (o_totalprice)""",
)
def many_class_codes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(ordering.class_codes(orders, "o_totalprice"), "o_totalprice").select("o_orderkey", "code")


@query(
    "missing_prediction_sentinel",
    f"""WITH {DETECTIONS_SQL} SELECT model, coalesce(y_pred, '<NONE>') AS label, count(*) AS n FROM det GROUP BY ALL""",
)
def missing_prediction_sentinel(spark, sf):
    from gridvigil.operators.scoring import fill_missing_prediction

    filled = detections(spark, sf).select("model", fill_missing_prediction().alias("label"))
    return filled.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mean_std_text",
    """WITH a AS (SELECT l_returnflag, avg(l_discount) AS m, stddev_pop(l_discount) AS s FROM lineitem GROUP BY 1)
    SELECT l_returnflag, printf('%.4f ± %.4f', m, s) AS shown, round(m, 4) AS mean, round(s, 4) AS std FROM a""",
)
def mean_std_text(spark, sf):
    stats = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_discount").alias("m"), F.stddev_pop("l_discount").alias("s")
    )
    shown = stats.select(
        "l_returnflag", statistics.mean_std_text(F.col("m"), F.col("s")).alias("shown")
    )
    return shown.withColumn("mean", statistics.mean_from_text(F.col("shown"))).withColumn(
        "std", statistics.std_from_text(F.col("shown"))
    )


@query(
    "request_hash",
    """SELECT conv_id, turn, sha1(concat_ws(chr(31), 'alpha', '0.0', role, text)) AS request FROM conversations""",
)
def request_hash(spark, sf):
    rows = table(spark, sf, "conversations").withColumns(
        {"model": F.lit("alpha"), "temperature": F.lit("0.0")}
    )
    return rows.select(
        "conv_id", "turn", statistics.request_key("model", "temperature", "role", "text").alias("request")
    )


_P_SQL = """p AS (SELECT o_orderkey, (o_totalprice - 250000) / 1000 AS delta,
  pow(10::DOUBLE, -(o_custkey % 60)) AS p FROM orders)"""


def _p_table(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        ((F.col("o_totalprice") - 250000) / 1000).alias("delta"),
        F.pow(F.lit(10.0), -(F.col("o_custkey") % 60).cast("double")).alias("p"),
    )


@query(
    "signed_significance",
    f"""WITH {_P_SQL} SELECT o_orderkey,
      round(CASE WHEN delta >= 0 THEN 1 ELSE -1 END * least(50, -log10(greatest(p, 1e-50))), 6) AS wide,
      round(CASE WHEN delta > 0 THEN 1 ELSE -1 END * least(3.5::DOUBLE, -log10(greatest(p, 1e-10))), 6) AS tight
    FROM p""",
)
def signed_significance(spark, sf):
    delta, p = F.col("delta"), F.col("p")
    shown = _p_table(spark, sf).select(
        "o_orderkey",
        statistics.signed_significance(delta, p).alias("wide"),
        statistics.signed_significance(delta, p, 1e-10, 3.5, zero_is_positive=False).alias("tight"),
    )
    return rounded(shown, ["wide", "tight"], 6)


@query(
    "significance_marks",
    f"""WITH {_P_SQL} SELECT o_orderkey, CASE WHEN p < 0.05 THEN '*' ELSE '' END AS star,
      CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction,
      CASE WHEN p < 0.001 THEN printf('%.0e', p) ELSE printf('%.2f', p) END AS short_p,
      CASE WHEN p < 0.01 THEN printf('%.2e', p) ELSE printf('%.3f', p) END AS table_p FROM p""",
)
def significance_marks(spark, sf):
    delta, p = F.col("delta"), F.col("p")
    return _p_table(spark, sf).select(
        "o_orderkey",
        statistics.star(p).alias("star"),
        statistics.direction(delta).alias("direction"),
        statistics.short_p(p).alias("short_p"),
        statistics.table_p(p).alias("table_p"),
    )
