"""Registered queries for ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridvigil.operators import timeseries
from gridvigil.operators.ordering import with_position
from gridvigil.plans.detections import rounded
from gridvigil.plans.registry import query, table

#: small blocks, so that even the test tables have block borders
BLOCK = 512
CLASSES = "CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END"


def series(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_type",
        F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("label"),
    )


_SERIES_SQL = f"""s AS (SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  event_type, {CLASSES} AS label FROM events)"""


@query(
    "row_index",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events",
)
def row_index(spark, sf):
    return with_position(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"]).select(
        "event_id", "pos"
    )


@query(
    "row_index_hot_key",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 3, o_orderkey) - 1 AS pos FROM orders",
)
def row_index_hot_key(spark, sf):
    """Three key values hold all rows, so ranges are cut again by the second key."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("c"), "o_orderkey")
    return with_position(rows, ["c", "o_orderkey"]).select("o_orderkey", "pos")


@query(
    "row_index_text_key",
    """SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST, doc_id) - 1 AS pos FROM documents""",
)
def row_index_text_key(spark, sf):
    """File order: a hot source, as a path, is cut again by what follows."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return with_position(rows, ["source", "lang", "doc_id"]).select("doc_id", "pos")


@query(
    "row_index_text_key_per_class",
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, text, doc_id) - 1 AS pos FROM documents""",
)
def row_index_text_key_per_class(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return with_position(rows, ["source", "text", "doc_id"], ["lang"]).select("doc_id", "lang", "pos")


@query(
    "row_index_per_class",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events""",
)
def row_index_per_class(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return with_position(rows, ["event_id"], ["event_type"])


@query(
    "deltas_whole_series",
    f"""WITH {_SERIES_SQL} SELECT event_id, round(coalesce(value - lag(value) OVER (ORDER BY event_id), 0), 6) AS value_delta,
      coalesce(k - lag(k) OVER (ORDER BY event_id), 0) AS k_delta FROM s""",
)
def deltas_whole_series(spark, sf):
    made = timeseries.add_deltas(series(spark, sf), ["value", "k"], ["event_id"], block_rows=BLOCK)
    return rounded(made.select("event_id", "value_delta", "k_delta"), ["value_delta"], 6)


@query(
    "deltas_per_user",
    f"""WITH {_SERIES_SQL} SELECT event_id,
      round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 6) AS value_delta FROM s""",
)
def deltas_per_user(spark, sf):
    made = timeseries.add_deltas(
        series(spark, sf), ["value"], ["event_id"], ["user_id"], block_rows=BLOCK
    )
    return rounded(made.select("event_id", "value_delta"), ["value_delta"], 6)


@query(
    "rolling_whole_series",
    f"""WITH {_SERIES_SQL} SELECT event_id, round(avg(value) OVER w, 6) AS value_rmean,
      round(coalesce(stddev_samp(value) OVER w, 0), 6) AS value_rstd FROM s
    WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_whole_series(spark, sf):
    made = timeseries.add_rolling(series(spark, sf), ["value"], ["event_id"], 5, block_rows=BLOCK)
    columns = ["value_rmean", "value_rstd"]
    return rounded(made.select("event_id", *columns), columns, 6)


@query(
    "rolling_per_user",
    f"""WITH {_SERIES_SQL} SELECT event_id, round(avg(k) OVER w, 6) AS k_rmean,
      round(coalesce(stddev_samp(k) OVER w, 0), 6) AS k_rstd FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def rolling_per_user(spark, sf):
    made = timeseries.add_rolling(
        series(spark, sf), ["k"], ["event_id"], 10, ["user_id"], block_rows=BLOCK
    )
    return rounded(made.select("event_id", "k_rmean", "k_rstd"), ["k_rmean", "k_rstd"], 6)


def _windows_sql(partition: str, size: int, stride: int) -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""{_SERIES_SQL}, p AS (SELECT *, row_number() OVER ({by}ORDER BY event_id) - 1 AS pos FROM s),
    w AS (SELECT pos, {partition + "," if partition else ""} (pos - {size - 1}) // {stride} AS window_id,
      list(value) OVER fr AS v, list(k) OVER fr AS kk, list(label) OVER fr AS ls, list(event_type) OVER fr AS es,
      avg(value) OVER fr AS m, stddev_pop(value) OVER fr AS sd, min(value) OVER fr AS mn, max(value) OVER fr AS mx,
      value AS last_value, k AS last_k, label AS last_label
    FROM p WINDOW fr AS ({by}ORDER BY event_id ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)),
    f AS (SELECT * FROM w WHERE pos >= {size - 1} AND (pos - {size - 1}) % {stride} = 0)"""


_STAT = ["value_mean", "value_std", "value_min", "value_max", "value_delta"]


@query(
    "window_stats_whole_series",
    f"""WITH {_windows_sql("", 10, 5)} SELECT window_id, round(m, 6) AS value_mean, round(sd, 6) AS value_std,
      mn AS value_min, mx AS value_max, round(v[10] - v[1], 6) AS value_delta,
      CASE WHEN list_contains(ls, 'Attack') THEN 'Attack' ELSE ls[1] END AS label FROM f""",
)
def window_stats_whole_series(spark, sf):
    made = timeseries.sliding_windows(
        series(spark, sf), ["value"], "label", ["event_id"], 10, 5, block_rows=BLOCK
    )
    return rounded(made, ["value_mean", "value_std", "value_delta"], 6)


@query(
    "window_stats_per_user",
    f"""WITH {_windows_sql("user_id", 8, 3)} SELECT user_id, window_id, round(m, 6) AS value_mean, round(sd, 6) AS value_std,
      mn AS value_min, mx AS value_max, round(v[8] - v[1], 6) AS value_delta,
      CASE WHEN list_contains(ls, 'Attack') THEN 'Attack' ELSE ls[1] END AS label FROM f""",
)
def window_stats_per_user(spark, sf):
    made = timeseries.sliding_windows(
        series(spark, sf), ["value"], "label", ["event_id"], 8, 3, group_cols=["user_id"],
        block_rows=BLOCK,
    )
    return rounded(made, ["value_mean", "value_std", "value_delta"], 6)


@query(
    "window_flatten",
    f"""WITH {_windows_sql("", 4, 3)}, e AS (SELECT window_id, x AS label, count(*) AS n FROM f, LATERAL (SELECT unnest(es) AS x) GROUP BY ALL),
    b AS (SELECT window_id, label FROM e QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY n DESC, label) = 1)
    SELECT window_id, """
    + ", ".join(f"v[{i + 1}] AS value_t{i}, kk[{i + 1}] AS k_t{i}" for i in range(4))
    + ", label AS event_type FROM f JOIN b USING (window_id)",
)
def window_flatten(spark, sf):
    return timeseries.sliding_windows(
        series(spark, sf), ["value", "k"], "event_type", ["event_id"], 4, 3, "flatten",
        block_rows=BLOCK,
    )


@query(
    "window_last_row",
    f"""WITH {_windows_sql("", 6, 4)} SELECT window_id, last_value AS value, last_k AS k, last_label AS label FROM f""",
)
def window_last_row(spark, sf):
    return timeseries.sliding_windows(
        series(spark, sf), ["value", "k"], "label", ["event_id"], 6, 4, "last"
    )
