"""Registered queries for scans and sinks.

Each writes a table derived from the given ones to the shared scratch folder in the form
under test, and reads it back.
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from gridvigil.operators import cleaning, scoring
from gridvigil.plans import experiments
from gridvigil.plans.detections import DETECTIONS_SQL, ORDERS_SQL, detections, labelled_orders, metrics_sql, rounded
from gridvigil.plans.model_queries import SIGNAL_FEATURES, signal
from gridvigil.plans.preparation import prepare
from gridvigil.plans.registry import query, table
from gridvigil.sources import archives, datasets, files, tables


def _exported(spark, sf):
    """events as two text exports: semicolons with decimal commas, and plain commas."""
    folder = tables.scratch_path(spark, "exports")
    e = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    comma = text(e.where("event_type = 'error'")).withColumn("value", F.replace("value", F.lit("."), F.lit(",")))
    comma = comma.select(F.col("event_id").alias(" event_id"), "user_id", F.col("value").alias("value "), "event_type")
    comma.write.option("sep", ";").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(f"{folder}/attack")
    text(e.where("event_type <> 'error'")).write.option("header", "true").csv(f"{folder}/normal")
    return folder


@query(
    "delimited_scan",
    "SELECT event_id, user_id, value, event_type FROM events",
)
def delimited_scan(spark, sf):
    """Both layouts found by recursive listing, united by stripped name, cast to numbers."""
    paths = files.find_files(spark, _exported(spark, sf))
    rows = files.read_delimited(spark, paths)
    return rows.select(
        F.col("event_id").try_cast("long").alias("event_id"),
        F.col("user_id").try_cast("long").alias("user_id"),
        cleaning.number(F.col("value")).alias("value"),
        "event_type",
    )


@query(
    "source_file_lineage",
    "SELECT event_type = 'error' AS attack, count(*) AS n, TRUE AS named FROM events GROUP BY ALL",
)
def source_file_lineage(spark, sf):
    rows = files.read_delimited(spark, files.find_files(spark, _exported(spark, sf)))
    named = F.col("_source_file").endswith(".csv")
    return rows.groupBy((F.col("event_type") == "error").alias("attack")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(named).alias("named")
    )


@query(
    "densest_file_mixed",
    f"""WITH {ORDERS_SQL}, f AS (SELECT *, year(o_orderdate) AS file FROM lab),
    s AS (SELECT file, count(*) AS n FROM f GROUP BY file HAVING count(DISTINCT y_true) >= 2)
    SELECT file, row_id, y_true FROM f WHERE file = (SELECT file FROM s ORDER BY n DESC, file LIMIT 1)""",
)
def densest_file_mixed(spark, sf):
    rows = labelled_orders(spark, sf).withColumn("file", F.year("o_orderdate").cast("long"))
    return files.densest_files(rows, "file", "y_true").select("file", "row_id", "y_true")


@query(
    "densest_file_per_class",
    f"""WITH {ORDERS_SQL}, f AS (SELECT row_id, y_true, y_true || '-' || o_custkey % 3 AS file FROM lab),
    s AS (SELECT file, y_true, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT file FROM s QUALIFY row_number() OVER (PARTITION BY y_true ORDER BY n DESC, file) = 1)
    SELECT file, row_id, y_true FROM f JOIN b USING (file)""",
)
def densest_file_per_class(spark, sf):
    name = F.concat_ws("-", "y_true", (F.col("o_custkey") % 3).cast("string"))
    rows = labelled_orders(spark, sf).withColumn("file", name)
    return files.densest_files(rows, "file", "y_true").select("file", "row_id", "y_true")


@query(
    "union_by_name",
    """SELECT o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS note, NULL::VARCHAR AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""",
)
def union_by_name(spark, sf):
    left = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note ")
    )
    right = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    parts = [cleaning.strip_headers(p) for p in (left, right)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("processed_table_sink", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def processed_table_sink(spark, sf):
    path = tables.scratch_path(spark, "processed")
    tables.save_processed(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), path
    )
    return spark.read.parquet(path)


RUN = ["dataset", "model", "seed"]


def _scores(spark, sf):
    scores = scoring.detection_metrics(scoring.confusion_counts(detections(spark, sf), RUN), RUN)
    return rounded(scores, ["macro_f1", "mcc"]).select(*RUN, "macro_f1", "mcc")


_SCORES_SQL = f"""WITH {DETECTIONS_SQL}, {metrics_sql("dataset, model, seed")}
  SELECT dataset, model, seed, round(macro_f1, 9) AS macro_f1, round(mcc, 9) AS mcc FROM met"""


@query("result_table_sink", _SCORES_SQL)
def result_table_sink(spark, sf):
    path = tables.scratch_path(spark, "results")
    tables.save_results(_scores(spark, sf).withColumn("experiment", F.lit("E1")), path)
    schema = "model string, seed int, macro_f1 double, mcc double, dataset string, experiment string"
    return spark.read.option("header", "true").schema(schema).csv(path).drop("experiment")


@query("metrics_json_sink", _SCORES_SQL)
def metrics_json_sink(spark, sf):
    path = tables.scratch_path(spark, "metrics")
    tables.save_metrics_json(_scores(spark, sf).withColumn("runs", F.lit("detail")), path)
    return spark.read.schema("dataset string, model string, seed int, macro_f1 double, mcc double").json(path)


@query(
    "prediction_store",
    f"WITH {DETECTIONS_SQL} SELECT dataset, model, seed, row_id, y_true, y_pred FROM det WHERE model = 'beta'",
)
def prediction_store(spark, sf):
    """Written by run, read back with folder pruning on the model."""
    path = tables.scratch_path(spark, "predictions")
    tables.save_predictions(
        detections(spark, sf).select(*RUN, "row_id", "y_true", "y_pred"), path
    )
    return spark.read.parquet(path).where("model = 'beta'")


@query("run_table_scan", _SCORES_SQL)
def run_table_scan(spark, sf):
    """One CSV folder per data set; the data set comes back from the path."""
    path = tables.scratch_path(spark, "runs")
    scores = _scores(spark, sf)
    for name in ("flow", "grid", "plant"):
        part = scores.where(F.col("dataset") == name).drop("dataset")
        part.write.option("header", "true").csv(f"{path}/multiclass/e1_{name}.csv")
    rows = tables.read_runs(
        spark,
        f"{path}/*/*.csv",
        "model string, seed int, macro_f1 double, mcc double",
        dataset=r"e1_([a-z]+)\.csv/",
    )
    return rows.where("mode = 'multiclass'").drop("mode")


@query("zip_member_scan", "SELECT event_id, value, event_type FROM events")
def zip_member_scan(spark, sf):
    """Archives of at most 1000 rows each, member in a sub-folder, read by base name."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("out/other.csv", "x\n1\n")
            archive.writestr(
                "out/run.csv", group[["event_id", "value", "event_type"]].to_csv(index=False)
            )
        return pd.DataFrame({"path": [f"a{group['part'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    rows = table(spark, sf, "events").select(
        "event_id", "value", "event_type", F.expr("event_id div 1000").alias("part")
    )
    packed = rows.groupBy("part").applyInPandas(pack, "path string, content binary")
    lines = archives.member_lines(packed, "run.csv")
    parsed = archives.csv_rows(lines, "event_id long, value double, event_type string")
    return parsed.select("event_id", "value", "event_type")


@query(
    "sensor_table_cleaning",
    """WITH raw AS (SELECT event_id, round(value * 10) / 10 AS lit101, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS fit101,
      CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END AS label FROM events WHERE event_id % 13 <> 0)
    SELECT lit101, fit101, label, count(*) AS n FROM raw GROUP BY ALL""",
)
def sensor_table_cleaning(spark, sf):
    """Text sensors, a time column, bad readings and a misspelt label, cleaned in one go."""
    e = table(spark, sf, "events")
    raw = e.select(
        F.col("ts").cast("string").alias(" Timestamp"),
        F.when(F.col("event_id") % 13 == 0, "bad")
        .otherwise((F.round(F.col("value") * 10) / 10).cast("string"))
        .alias("lit101 "),
        F.get_json_object("props", "$.k").alias("fit101"),
        F.lit(None).cast("string").alias("empty"),
        F.when(F.col("event_type") == "error", "A ttack").otherwise("Normal").alias("Normal/Attack"),
    )
    clean = datasets.clean_swat(raw)
    return clean.groupBy("lit101", "fit101", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "indicator_table_cleaning",
    """SELECT CASE WHEN event_id % 10 = 0 OR user_id % 11 = 0 THEN 'Attack' ELSE 'Normal' END AS label, count(*) AS n,
      round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def indicator_table_cleaning(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("ts").cast("string").alias("time"),
        F.col("value").cast("string").alias("P1_B2004"),
        (F.col("event_id") % 10 == 0).cast("int").cast("string").alias("attack_P1"),
        (F.col("user_id") % 11 == 0).cast("int").cast("string").alias("attack_P2"),
    )
    clean = datasets.clean_hai(raw)
    return clean.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("P1_B2004"), 4).alias("total")
    )


@query(
    "flow_table_cleaning",
    """SELECT CASE o_custkey % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'DoS' ELSE 'Reconn' END AS label, count(*) AS n,
      round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""",
)
def flow_table_cleaning(spark, sf):
    kind = (
        F.when(F.col("o_custkey") % 3 == 0, "normal").when(F.col("o_custkey") % 3 == 1, "DoS").otherwise("Scan")
    )
    raw = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("string").alias("StartTime"),
        F.col("o_custkey").cast("string").alias("SrcAddr"),
        F.col("o_totalprice").cast("string").alias("TotBytes"),
        kind.alias("Traffic"),
        (F.col("o_custkey") % 3 > 0).cast("int").cast("string").alias("Target"),
    )
    clean = datasets.clean_wustl(raw)
    if "Target" in clean.columns or "SrcAddr" in clean.columns:
        raise ValueError("label or address columns left among the features")
    return clean.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("TotBytes"), 2).alias("total")
    )


@query(
    "prepared_features",
    """WITH d AS (SELECT l_quantity, l_tax, l_returnflag FROM lineitem GROUP BY ALL),
    s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM d)
    SELECT round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax, l_returnflag AS label FROM d, s""",
)
def prepared_features(spark, sf):
    """Constant column and repeats dropped, then standardised."""
    raw = table(spark, sf, "lineitem").select(
        "l_quantity", "l_tax", F.lit(1.0).alias("fixed"), F.col("l_returnflag").alias("label")
    )
    return rounded(prepare(raw, datasets.SWAT), ["l_quantity", "l_tax"], 6)


@query("baseline_comparison")
def baseline_comparison(spark, sf):
    """Two models, three seeds, scored in one aggregate."""
    from gridvigil.operators import classifiers

    models = {"tree": classifiers.tree, "forest": lambda: classifiers.forest(numTrees=10, maxDepth=6)}
    predictions, failed = experiments.compare_models(
        signal(spark, sf), SIGNAL_FEATURES, "label", "o_orderkey", models
    )
    return experiments.comparison_table(predictions, failed)


@query("few_shot_sweep")
def few_shot_sweep(spark, sf):
    from gridvigil.operators import classifiers

    predictions = experiments.few_shot_sweep(
        signal(spark, sf),
        SIGNAL_FEATURES,
        "label",
        "o_orderkey",
        {"tree": classifiers.tree},
        shots=(10, 100),
        runs=2,
    )
    return experiments.few_shot_table(predictions)


@query("rare_attack_study")
def rare_attack_study(spark, sf):
    from gridvigil.operators import classifiers

    predictions, _ = experiments.compare_models(
        signal(spark, sf), SIGNAL_FEATURES, "label", "o_orderkey", {"tree": classifiers.tree}, seeds=(42,)
    )
    return experiments.rare_attack_table(predictions, threshold=500)
