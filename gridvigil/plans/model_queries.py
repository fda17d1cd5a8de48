"""Registered queries for scaling, feature ranking, neighbours, oversampling and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridvigil.operators import boosting, classifiers, features, neighbours, oversampling, sampling, scoring
from gridvigil.plans import transfer
from gridvigil.plans.detections import rounded
from gridvigil.plans.registry import query, table
from gridvigil.session import scratch_path

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flows(spark, sf):
    """lineitem with a binary label; keys identify a row."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        *FEATURES,
        F.when(F.col("l_returnflag") == "N", "Normal").otherwise("Attack").alias("label"),
        "l_returnflag",
    )


def signal(spark, sf):
    """orders with a class that the features can tell, for models."""
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    label = (
        F.when((price > 400_000) & (F.col("o_custkey") % 5 > 0), "DoS")
        .when((price < 60_000) & (F.col("o_custkey") % 7 > 0), "Reconn")
        .otherwise("Normal")
    )
    return o.select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        (F.col("o_custkey") % 97).cast("double").alias("site"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.dayofmonth("o_orderdate").cast("double").alias("day"),
        label.alias("label"),
    )


SIGNAL_FEATURES = ["price", "site", "month", "day"]


@query(
    "standardise",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES)
    + ", CAST(0 AS DOUBLE) AS flat FROM lineitem, s",
)
def standardise(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES)
    rows = rows.withColumn("flat", F.lit(3.0))
    return rounded(features.standardise(rows, [*FEATURES, "flat"]), FEATURES, 6)


@query(
    "standardise_fit_on_train",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_tax, l_returnflag FROM lineitem),
    s AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS sd FROM t WHERE l_returnflag = 'N')
    SELECT l_orderkey, l_linenumber, round((l_tax - m) / sd, 6) AS l_tax FROM t, s""",
)
def standardise_fit_on_train(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")
    train = rows.where("l_returnflag = 'N'")
    scaled = features.standardise(rows, ["l_tax"], fit_on=train)
    return rounded(scaled.drop("l_returnflag"), ["l_tax"], 6)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
    )


def vector_columns(spark, sf, n: int = 64):
    return vectors(spark, sf).select(
        "id", "label", *[F.col("vector")[i].alias(f"v{i}") for i in range(n)]
    )


@query("principal_components")
def principal_components(spark, sf):
    names = [f"v{i}" for i in range(64)]
    return features.principal_components(vector_columns(spark, sf), names, 25)


@query(
    "principal_components_of_two",
    """WITH x AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice + o_custkey * 100 AS b FROM orders),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM x)
    SELECT o_orderkey, round(((a - ma) / sa + (b - mb) / sb) / sqrt(2), 6) AS "PC1",
      round(abs((a - ma) / sa - (b - mb) / sb) / sqrt(2), 6) AS "PC2" FROM x, s""",
)
def principal_components_of_two(spark, sf):
    """Two correlated columns have the components (1, 1) and (1, -1); the second's sign is free."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("a"),
        (F.col("o_totalprice") + F.col("o_custkey") * 100).alias("b"),
    )
    made = features.principal_components(rows, ["a", "b"], 2)
    return rounded(made.withColumn("PC2", F.abs("PC2")), ["PC1", "PC2"], 6)


@query("aligned_feature_spaces")
def aligned_feature_spaces(spark, sf):
    flow = flows(spark, sf).select("l_orderkey", *FEATURES)
    plant = signal(spark, sf).select("o_orderkey", *SIGNAL_FEATURES)
    left, right, names = features.align_feature_spaces(flow, FEATURES, plant, SIGNAL_FEATURES)
    spread_of = lambda df, name: df.agg(
        *[F.stddev_pop(c).alias(c) for c in names]
    ).withColumn("side", F.lit(name))
    return spread_of(left, "source").unionByName(spread_of(right, "target"))


@query("class_separation")
def class_separation(spark, sf):
    names = [f"v{i}" for i in range(64)]
    return features.class_separation(vector_columns(spark, sf), names, "label")


_MI_SQL = """long AS (
    SELECT 'l_discount' AS feature, l_discount AS x, l_returnflag || l_linestatus || CASE WHEN l_discount > 0.055 AND l_tax > 0.045 THEN 'x' ELSE 'y' END AS label FROM lineitem
    UNION ALL SELECT 'l_tax', l_tax, l_returnflag || l_linestatus || CASE WHEN l_discount > 0.055 AND l_tax > 0.045 THEN 'x' ELSE 'y' END FROM lineitem
    UNION ALL SELECT 'l_linenumber', l_linenumber, l_returnflag || l_linestatus || CASE WHEN l_discount > 0.055 AND l_tax > 0.045 THEN 'x' ELSE 'y' END FROM lineitem),
  j AS (SELECT feature, x AS bin, label, count(*) AS n FROM long GROUP BY ALL),
  p AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS nb,
    sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS na FROM j),
  mi AS (SELECT feature, round(sum(n / na * ln(n::DOUBLE * na / (nb::DOUBLE * nl))), 8) AS mi FROM p GROUP BY feature)"""


def _mi(spark, sf):
    """Few distinct values per feature, so every value is a bin of its own."""
    odd = F.when((F.col("l_discount") > 0.055) & (F.col("l_tax") > 0.045), "x").otherwise("y")
    rows = table(spark, sf, "lineitem").withColumn(
        "label", F.concat("l_returnflag", "l_linestatus", odd)
    )
    names = ["l_discount", "l_tax", "l_linenumber"]
    scores = features.binned_mutual_information(rows, names, "label", bins=64)
    return rounded(scores, ["mi"], 8)


@query("binned_mutual_information", f"WITH {_MI_SQL} SELECT * FROM mi")
def binned_mutual_information(spark, sf):
    return _mi(spark, sf)


@query(
    "top_features",
    f"WITH {_MI_SQL} SELECT feature, mi FROM mi ORDER BY mi DESC, feature LIMIT 2",
)
def top_features(spark, sf):
    return features.top_features(_mi(spark, sf), 2)


_PSI = """(ln({n} + 6) - 0.5::DOUBLE / ({n} + 6) - 1::DOUBLE / 12 / pow({n} + 6, 2) + 1::DOUBLE / 120 / pow({n} + 6, 4)
  - 1::DOUBLE / 252 / pow({n} + 6, 6) - (1::DOUBLE / {n} + 1::DOUBLE / ({n} + 1) + 1::DOUBLE / ({n} + 2) + 1::DOUBLE / ({n} + 3)
  + 1::DOUBLE / ({n} + 4) + 1::DOUBLE / ({n} + 5)))"""
_DIGEST_PART = "CAST('0x' || substr(md5(concat_ws(':', md5(concat('0:', c_custkey)), feature)), {at}, 13) AS BIGINT) / pow(16::DOUBLE, 13)"


@query(
    "knn_mutual_information",
    f"""WITH r AS (SELECT c_custkey, c_mktsegment AS y, unnest(['c_acctbal', 'nation']) AS feature,
      unnest([c_acctbal::DOUBLE + length(c_mktsegment) * 500, c_nationkey::DOUBLE + CASE WHEN c_mktsegment < 'F' THEN 9 ELSE 0 END]) AS x FROM customer),
    s AS (SELECT feature, stddev_pop(x) AS scale, greatest(1, avg(abs(x)) / stddev_pop(x)) AS size FROM r GROUP BY feature),
    v AS (SELECT c_custkey, feature, y, x / scale + 1e-10::DOUBLE * size * ({_DIGEST_PART.format(at=1)} + {_DIGEST_PART.format(at=14)} - 1) AS x
      FROM r JOIN s USING (feature)),
    g AS (SELECT a.feature, a.c_custkey, a.x, abs(a.x - b.x) AS gap, row_number() OVER (PARTITION BY a.feature, a.c_custkey ORDER BY abs(a.x - b.x)) AS rn
      FROM v a JOIN v b ON a.feature = b.feature AND a.y = b.y AND a.c_custkey <> b.c_custkey),
    n AS (SELECT feature, c_custkey, x, gap - 1e-14::DOUBLE * greatest(1, abs(x)) AS radius FROM g WHERE rn = 3),
    w AS (SELECT n.feature, n.c_custkey, count(*) AS within FROM n JOIN v ON n.feature = v.feature AND v.x BETWEEN n.x - n.radius AND n.x + n.radius GROUP BY ALL),
    l AS (SELECT feature, c_custkey, count(*) OVER (PARTITION BY feature, y) AS n_label FROM v),
    m AS (SELECT feature, {_PSI.format(n="count(*)")} + {_PSI.format(n="3")} - avg({_PSI.format(n="n_label")}) - avg({_PSI.format(n="within")}) AS mi
      FROM w JOIN l USING (feature, c_custkey) GROUP BY feature)
    SELECT feature, round(greatest(0, mi), 6) AS mi FROM m""",
)
def knn_mutual_information(spark, sf):
    """All rows; one feature has many ties."""
    c = table(spark, sf, "customer")
    rows = c.select(
        "c_custkey", "c_mktsegment",
        (F.col("c_acctbal").cast("double") + F.length("c_mktsegment") * 500).alias("c_acctbal"),
        (F.col("c_nationkey").cast("double") + F.when(F.col("c_mktsegment") < "F", 9).otherwise(0)).alias("nation"),
    )
    found = features.knn_mutual_information(rows, ["c_acctbal", "nation"], "c_mktsegment", ["c_custkey"])
    return rounded(found, ["mi"], 6)


@query("neighbour_layout")
def neighbour_layout(spark, sf):
    """A 2-D view of the rows of a sample of at most 300 a class."""
    names = [f"v{i}" for i in range(64)]
    rows = sampling.cap_per_class(vector_columns(spark, sf), "label", 300, ["id"])
    return features.neighbour_layout(rows, names, "id").select("id", "label", "x", "y")


_SPLIT_SQL = """e AS (SELECT vec_id AS id, embedding, 'c' || label AS label,
    row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', vec_id))) AS rn,
    round_even(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE, 0) AS cut FROM embeddings),
  tr AS (SELECT * FROM e WHERE rn > cut), te AS (SELECT * FROM e WHERE rn <= cut),
  d AS (SELECT te.id, tr.id AS nid, tr.label, sqrt(list_sum(list_transform(range(1, 65),
      lambda i: pow(te.embedding[i]::DOUBLE - tr.embedding[i]::DOUBLE, 2)))) AS dist FROM te, tr),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM d)"""


def _train_test(spark, sf):
    parts = sampling.pool_and_holdout(vectors(spark, sf), "label", ["id"], 0.3)
    columns = ["id", "vector", "label"]
    return parts.where("part = 'pool'").select(*columns), parts.where("part = 'holdout'").select(*columns)


@query(
    "nearest_neighbours",
    f"""WITH {_SPLIT_SQL} SELECT id, nid AS neighbour, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank, label
    FROM n WHERE rank <= 8""",
)
def nearest_neighbours(spark, sf):
    train, test = _train_test(spark, sf)
    return rounded(neighbours.nearest(train, test, 8, keep=["label"]), ["distance"], 6)


@query(
    "knn_classify",
    f"""WITH {_SPLIT_SQL}, v AS (SELECT id, label AS y_pred, count(*) AS votes FROM n WHERE rank <= 8 GROUP BY ALL)
    SELECT id, y_pred, votes FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, y_pred) = 1""",
)
def knn_classify(spark, sf):
    train, test = _train_test(spark, sf)
    return neighbours.knn_classify(train, test, "label")


def imbalanced(spark, sf):
    """Three classes of very different size."""
    big = F.when(F.col("label").isin("c0", "c1"), F.col("label")).otherwise("rest")
    return vectors(spark, sf).withColumn("label", big)


_IMB_SQL = """i AS (SELECT CASE WHEN label IN (0, 1) THEN 'c' || label ELSE 'rest' END AS label FROM embeddings)"""


@query(
    "smote_class_sizes",
    f"""WITH {_IMB_SQL}, c AS (SELECT label, count(*) AS n FROM i GROUP BY label)
    SELECT label, n AS originals, max(n) OVER () - n AS synthetic FROM c""",
)
def smote_class_sizes(spark, sf):
    made = oversampling.smote(imbalanced(spark, sf), "label")
    return made.groupBy("label").agg(
        F.count(F.when(F.col("copy").isNull(), 1)).alias("originals"), F.count("copy").alias("synthetic")
    )


#: distances between all rows, and the k nearest rows of the same class
_OVER_SQL = """i AS (SELECT vec_id AS id, embedding, CASE WHEN label IN (0, 1) THEN 'c' || label ELSE 'rest' END AS label FROM embeddings),
  sizes AS (SELECT label, count(*) AS n FROM i GROUP BY label),
  kk AS (SELECT greatest(1, least(5, min(n) - 1)) AS k, max(n) AS top FROM sizes),
  small AS (SELECT i.*, top - n AS missing FROM i JOIN sizes USING (label), kk WHERE n < top),
  d AS (SELECT a.id, b.id AS nid, a.label, b.label AS nlabel, sqrt(list_sum(list_transform(range(1, 65),
      lambda j: pow(a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE, 2)))) AS dist
    FROM small a, i b WHERE a.id <> b.id),
  near AS (SELECT id, list(nid ORDER BY dist, nid) AS nids FROM (SELECT * FROM d WHERE label = nlabel
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nid) <= (SELECT k FROM kk)) GROUP BY id)"""


def _made_sql(base: str) -> str:
    """Synthetic rows from ``base`` (id, embedding, label, copies)."""
    return f"""cp AS (SELECT b.id, b.embedding, b.label, unnest(range(b.copies)) AS copy FROM {base} b WHERE b.copies > 0),
  ch AS (SELECT cp.*, nids[CAST(CAST('0x' || substr(md5(concat('42:', id, ':', copy)), 1, 15) AS BIGINT) % len(nids) + 1 AS INT)] AS nid,
      CAST('0x' || substr(md5(concat('43:', id, ':', copy)), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE AS gap
    FROM cp JOIN near USING (id))
  SELECT ch.id AS base, copy, nid AS neighbour, ch.label, round(list_sum(list_transform(range(1, 65),
      lambda j: ch.embedding[j]::DOUBLE + gap * (e.embedding[j]::DOUBLE - ch.embedding[j]::DOUBLE))), 6) AS total
  FROM ch JOIN i e ON e.id = nid
  UNION ALL SELECT id, NULL, NULL, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) FROM i"""


_EVEN_SQL = """even AS (SELECT b.id, b.embedding, b.label, missing // count(*) OVER (PARTITION BY label)
    + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', b.id))) <= missing % count(*) OVER (PARTITION BY label)
      THEN 1 ELSE 0 END AS copies FROM {base} b)"""


def _shares_sql(k: str) -> str:
    return f"""sh AS (SELECT id, avg(CASE WHEN label <> nlabel THEN 1 ELSE 0 END) AS share FROM (SELECT * FROM d
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nid) <= {k}) GROUP BY id)"""


def _totals(made):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return made.select("base", "copy", "neighbour", "label", F.round(total, 6).alias("total"))


@query("smote_rows", f"WITH {_OVER_SQL}, {_EVEN_SQL.format(base='small')}, {_made_sql('even')}")
def smote_rows(spark, sf):
    return _totals(oversampling.balance(imbalanced(spark, sf), "label", "smote"))


@query(
    "borderline_smote_rows",
    f"""WITH {_OVER_SQL}, {_shares_sql("10")}, danger AS (SELECT small.* FROM small JOIN sh USING (id) WHERE share >= 0.5 AND share < 1),
    {_EVEN_SQL.format(base="danger")}, {_made_sql("even")}""",
)
def borderline_smote_rows(spark, sf):
    return _totals(oversampling.balance(imbalanced(spark, sf), "label", "borderline"))


@query(
    "adasyn_rows",
    f"""WITH {_OVER_SQL}, {_shares_sql("(SELECT k FROM kk)")}, prop AS (SELECT small.id, embedding, small.label,
      CAST(round_even(share * (missing / sum(share) OVER (PARTITION BY small.label)), 0) AS BIGINT) AS copies FROM small JOIN sh USING (id)),
    {_made_sql("prop")}""",
)
def adasyn_rows(spark, sf):
    return _totals(oversampling.balance(imbalanced(spark, sf), "label", "adasyn"))


def _train_and_predict(spark, sf, estimator, balanced=True, binary=False):
    data = signal(spark, sf)
    if binary:
        data = data.withColumn("label", F.when(F.col("label") == "Normal", "Normal").otherwise("Attack"))
    parts = sampling.pool_and_holdout(data, "label", ["o_orderkey"], 0.3)
    train = parts.where("part = 'pool'").repartition("o_orderkey")
    detector = classifiers.fit(train, SIGNAL_FEATURES, "label", estimator, balanced)
    return detector.predict(parts.where("part = 'holdout'"))


def _metrics(scored):
    counts = scoring.confusion_counts(scored.withColumn("all", F.lit(1)), ["all"], y_true="label")
    return scoring.detection_metrics(counts, ["all"]).drop("all")


@query("random_forest_metrics")
def random_forest_metrics(spark, sf):
    return _metrics(_train_and_predict(spark, sf, classifiers.forest(numTrees=40, maxDepth=10)))


@query("decision_tree_metrics")
def decision_tree_metrics(spark, sf):
    return _metrics(_train_and_predict(spark, sf, classifiers.tree()))


@query("boosted_trees_metrics")
def boosted_trees_metrics(spark, sf):
    estimator = classifiers.boosting(rounds=20, depth=5)
    return _metrics(_train_and_predict(spark, sf, estimator, balanced=False, binary=True))


@query("balanced_boosted_trees_metrics")
def balanced_boosted_trees_metrics(spark, sf):
    return _metrics(_train_and_predict(spark, sf, classifiers.leaf_boosting(rounds=8, leaves=15)))


_STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _stump_rows(spark, sf):
    label = (
        F.when((F.col("l_quantity") > 30) & (F.col("l_discount") > 0.035), "DoS")
        .when((F.col("l_tax") < 0.025) & (F.col("l_linenumber") < 4), "Recon")
        .otherwise("Normal")
    )
    return table(spark, sf, "lineitem").select(*_STUMP_FEATURES, label.alias("label"))


@query(
    "boosted_multiclass_stumps",
    """WITH r AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, CASE WHEN l_quantity > 30 AND l_discount > 0.035 THEN 'DoS'
      WHEN l_tax < 0.025 AND l_linenumber < 4 THEN 'Recon' ELSE 'Normal' END AS label FROM lineitem),
    c AS (SELECT label AS class, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM r GROUP BY label),
    x AS (SELECT label, unnest([0, 1, 2, 3]) AS f, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS feature,
      unnest([l_quantity, l_discount, l_tax, l_linenumber::DOUBLE]) AS v FROM r),
    g AS (SELECT class, f, feature, v, sum(round_even((p - CASE WHEN label = class THEN 1 ELSE 0 END) * 1048576, 0)) / 1048576 AS g,
      sum(round_even(2 * p * (1 - p) * 1048576, 0)) / 1048576 AS h, count(*) AS n FROM x, c GROUP BY ALL),
    l AS (SELECT class, f, feature, v, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl,
      sum(g) OVER w AS ga, sum(h) OVER w AS ha, sum(n) OVER w AS na FROM g
      WINDOW u AS (PARTITION BY class, f ORDER BY v), w AS (PARTITION BY class, f)),
    s AS (SELECT *, (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2 AS gain
      FROM l WHERE nl < na AND hl >= 1 AND ha - hl >= 1)
    SELECT class, feature, v AS up_to, round(gain, 4) AS gain, round(-gl / (hl + 1), 8) AS left_value,
      round(-(ga - gl) / (ha - hl + 1), 8) AS right_value
    FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY gain DESC, f, v) = 1""",
)
def boosted_multiclass_stumps(spark, sf):
    """The first split of each class's tree, of one model for all classes."""
    settings = classifiers.boosting(rounds=1, depth=1, bins=254)
    model = classifiers.fit(_stump_rows(spark, sf), _STUMP_FEATURES, "label", settings, balanced=False)
    nodes = model.splits(spark)
    values = {side: nodes.select("class", F.col("node").alias(side), F.col("value").alias(f"{side}_value")) for side in ("left", "right")}
    root = nodes.where("node = 0").join(values["left"], ["class", "left"]).join(values["right"], ["class", "right"])
    shown = root.select("class", "feature", "up_to", F.round("gain", 4).alias("gain"), "left_value", "right_value")
    return rounded(shown, ["left_value", "right_value"], 8)


@query("boosted_multiclass_metrics")
def boosted_multiclass_metrics(spark, sf):
    return _metrics(_train_and_predict(spark, sf, classifiers.boosting(rounds=10, depth=4)))


@query("saved_booster_scores")
def saved_booster_scores(spark, sf):
    """A booster after a write to and a read from the shared folder."""
    path = scratch_path(spark, "booster")
    model = classifiers.fit(signal(spark, sf), SIGNAL_FEATURES, "label", classifiers.boosting(rounds=2, depth=3))
    model.save(spark, path)
    scored = boosting.BoostedDetector.load(spark, path).predict(signal(spark, sf))
    return scored.select("o_orderkey", "y_pred", classifiers.attack_score().alias("score"))


@query("model_scores")
def model_scores(spark, sf):
    """Attack score, confidence and class of every held-out row."""
    scored = _train_and_predict(spark, sf, classifiers.tree())
    return scored.select(
        "o_orderkey",
        "label",
        "y_pred",
        classifiers.attack_score().alias("score"),
        classifiers.confidence().alias("conf"),
    )


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    """The detector after a write to and a read from the shared folder."""
    train = signal(spark, sf).repartition("o_orderkey")
    path = scratch_path(spark, "model")
    classifiers.fit(train, SIGNAL_FEATURES, "label", classifiers.tree(maxDepth=4)).save(path)
    scored = classifiers.Detector.load(path).predict(signal(spark, sf))
    return scored.select("o_orderkey", "y_pred", classifiers.attack_score().alias("score"))


_PROBA_SQL = """p AS (SELECT o_orderkey, (o_custkey % 10) / 20 AS a, (o_custkey % 7) / 20 AS b,
  1 - (o_custkey % 10) / 20 - (o_custkey % 7) / 20 AS c FROM orders)"""


@query(
    "attack_score_and_confidence",
    f"""WITH {_PROBA_SQL} SELECT o_orderkey, round(a + b, 9) AS score, round(greatest(a, b, c), 9) AS conf,
      CASE WHEN round(a, 9) >= round(greatest(b, c), 9) THEN 'DoS' WHEN round(c, 9) >= round(b, 9) THEN 'Normal'
      ELSE 'Recon' END AS y_pred FROM p""",
)
def attack_score_and_confidence(spark, sf):
    a, b = (F.col("o_custkey") % 10) / 20, (F.col("o_custkey") % 7) / 20
    proba = F.create_map(
        F.lit("DoS"), F.round(a, 9), F.lit("Recon"), F.round(b, 9), F.lit("Normal"), F.round(1 - a - b, 9)
    )
    rows = table(spark, sf, "orders").select("o_orderkey", proba.alias("proba"))
    shown = rows.select(
        "o_orderkey",
        classifiers.attack_score().alias("score"),
        classifiers.confidence().alias("conf"),
        classifiers.most_likely().alias("y_pred"),
    )
    return rounded(shown, ["score", "conf"])


@query(
    "batch_scoring",
    """SELECT event_id, round(1 / (1 + exp(-(value - 10) / 4)), 9) AS score,
      CASE WHEN value > 10 THEN 'Attack' ELSE 'Normal' END AS y_pred FROM events""",
)
def batch_scoring(spark, sf):
    """An outside model as a vectorised function."""

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        shifted = batch["value"] - 10
        return pd.DataFrame(
            {
                "event_id": batch["event_id"],
                "score": 1 / (1 + np.exp(-shifted / 4)),
                "y_pred": np.where(shifted > 0, "Attack", "Normal"),
            }
        )

    rows = table(spark, sf, "events").select("event_id", "value")
    scored = classifiers.score_batches(rows, scorer, "event_id long, score double, y_pred string", 5000)
    return rounded(scored, ["score"])


@query("cross_domain_transfer")
def cross_domain_transfer(spark, sf):
    def binary(df):
        return df.withColumn("label", F.when(F.col("label") == "Normal", "Normal").otherwise("Attack"))

    plant = binary(signal(spark, sf)).withColumnRenamed("o_orderkey", "key")
    flow = flows(spark, sf).withColumn(
        "key", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    )
    predicted = transfer.transfer_predictions(
        plant.withColumn("key", F.col("key").cast("string")),
        SIGNAL_FEATURES,
        flow,
        FEATURES,
        "label",
        "key",
        {"tree": classifiers.tree, "forest": lambda: classifiers.forest(numTrees=10, maxDepth=6)},
        seeds=(42, 43),
    )
    return transfer.transfer_report(predicted, ["accuracy", "macro_f1", "mcc", "far", "dr"])
