"""The many-range, many-block and skewed paths, forced on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridvigil.operators import cleaning, neighbours, ordering, oversampling, sampling, scoring, timeseries
from gridvigil.operators.comparison import bootstrap_interval


def skewed(spark, n=20_000):
    """One class holds two thirds, one a handful."""
    label = F.when(F.col("id") % 3 > 0, "Normal").when(F.col("id") % 300 == 0, "rare").otherwise("Attack")
    return spark.range(n).select(F.col("id").alias("key"), label.alias("label"))


@pytest.mark.parametrize("rank_rows", [1, 7, 100_000])
def test_cutoffs_are_exact_at_any_narrowing(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(sampling, "RANK_ROWS", rank_rows)
    monkeypatch.setattr(sampling, "RANGES_PER_PASS", 16)
    df = sampling.with_draw(skewed(spark), ["key"], 5)
    quota = sampling.share_quota(0.37)
    got = sampling.take_lowest(df, ["label"], quota).select("label", "digest").toPandas()
    whole = df.select("label", "digest").toPandas()
    for label, part in whole.groupby("label"):
        target = int(np.rint(len(part) * 0.37))
        want = sorted(part["digest"])[:target]
        assert sorted(got.loc[got["label"] == label, "digest"]) == want


def test_many_strata_fall_back_to_ranks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_STRATA", 2)
    df = sampling.with_draw(skewed(spark, 3000), ["key"], 5)
    sizes = sampling.take_lowest(df, ["label"], sampling.fixed_quota(40)).groupBy("label").count()
    assert {r["label"]: r["count"] for r in sizes.collect()} == {"Normal": 40, "Attack": 40, "rare": 10}


def with_nulls(spark, n=3000):
    """A class of null labels, keys that repeat, and times that repeat."""
    label = F.when(F.col("id") % 3 == 0, "Normal").when(F.col("id") % 3 == 1, "Attack")
    return spark.range(n).select(
        (F.col("id") % (n // 3)).alias("key"), F.col("id").alias("row"), label.alias("label"), (F.col("id") % 4).alias("at")
    )


@pytest.mark.parametrize("most", [2, 10_000])
@pytest.mark.parametrize("k", [7, 999, 1000, 1001])
def test_null_labels_and_repeated_keys(spark, monkeypatch, k, most):
    monkeypatch.setattr(sampling, "MAX_STRATA", most)
    df = with_nulls(spark)
    for keys in (["key"], ["row"], ["at"]):
        sizes = sampling.per_class(df, "label", k, keys).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in sizes} == {c: min(k, 1000) for c in ("Normal", "Attack", None)}
    assert sampling.cap_per_class(df, "label", k, order_col="at").count() == 3 * min(k, 1000)


def test_splits_keep_null_labels(spark):
    parts = sampling.stratified_split(with_nulls(spark), "label", ["row"]).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {
        (c, p): n for c in ("Normal", "Attack", None) for p, n in (("train", 700), ("test", 300))
    }
    chrono = sampling.chronological_split(with_nulls(spark), "label", "row", ["row"], shots=5).groupBy("label", "part").count()
    assert {(r["label"], r["part"]): r["count"] for r in chrono.collect()} == {
        (c, p): n for c in ("Normal", "Attack", None) for p, n in (("shot", 5), ("test", 200))
    }


def test_quotas_and_areas_of_huge_counts(spark):
    counts = spark.createDataFrame([("a", 7 * 10**12), ("b", 3 * 10**12)], "label string, n long")
    quota = sampling.apportioned_quota(lambda n: n - F.ceil(n * F.lit(0.3)), "label")(counts)
    assert {r["label"]: r["target"] for r in quota.collect()} == {"a": 49 * 10**11, "b": 21 * 10**11}
    n = 4 * 10**9
    curve = spark.createDataFrame([(1, n, n, n, n, n, n)], "run int, pos long, neg long, tp long, fp long, n_pos long, n_neg long")
    row = scoring.area_metrics(curve, ["run"]).first()
    assert (row["auroc"], row["auprc"]) == (0.5, 0.5)


def test_samples_do_not_depend_on_partitioning(spark):
    base = skewed(spark, 5000)
    results = []
    for df in (base.coalesce(1), base.repartition(4), base.repartition(17).orderBy(F.rand(3))):
        rows = sampling.per_class(df, "label", 30, ["key"], (1, 2)).select("seed", "label", "key")
        results.append(sorted(map(tuple, rows.collect())))
    assert results[0] == results[1] == results[2]


def test_smaller_samples_are_nested(spark):
    df = skewed(spark, 3000)
    small = {r["key"] for r in sampling.per_class(df, "label", 5, ["key"]).collect()}
    large = {r["key"] for r in sampling.per_class(df, "label", 50, ["key"]).collect()}
    assert small < large


def test_shot_and_test_are_disjoint_and_sized(spark):
    rows = sampling.shot_and_test(skewed(spark, 3000), "label", 8, 20, ["key"]).toPandas()
    assert rows["key"].is_unique
    sizes = rows.groupby(["label", "part"]).size().to_dict()
    # ten rare rows: shots first, the rest to test
    assert sizes[("rare", "shot")] == 8 and sizes[("rare", "test")] == 2
    assert sizes[("Normal", "shot")] == 8 and sizes[("Normal", "test")] == 20


@pytest.mark.parametrize("n, cut", [(100, 80), (6, 5), (5, 4), (1, None)])
def test_chronological_cut(spark, n, cut):
    df = spark.range(n).select(F.col("id").alias("key"), F.lit("a").alias("label"))
    rows = sampling.chronological_split(df, "label", "key", ["key"], shots=5).toPandas()
    test = sorted(rows.loc[rows["part"] == "test", "key"]) if len(rows) else []
    assert test == ([] if cut is None else list(range(cut, n)))


def test_prevalence_sample_has_exact_size(spark):
    for size in (7, 100, 1234):
        assert sampling.prevalence_sample(skewed(spark), "label", size, ["key"]).count() == size


def test_class_weights_of_ninety_and_ten(spark):
    df = spark.range(100).select(F.when(F.col("id") < 90, "a").otherwise("b").alias("label"))
    weights = {r["label"]: r["weight"] for r in sampling.class_weights(df, "label").collect()}
    assert weights == {"a": pytest.approx(100 / 180), "b": pytest.approx(100 / 20)}


def test_unstratified_when_a_class_has_one_row(spark):
    df = spark.range(50).select(
        F.col("id").alias("key"), F.when(F.col("id") == 0, "one").otherwise("many").alias("label")
    )
    rows = sampling.stratified_split(df, "label", ["key"])
    assert rows.where("part = 'test'").count() == 15


def test_positions_with_a_hot_key(spark):
    """Half the rows share one sort value."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id") * 1.5).alias("x"), "id"
    )
    got = ordering.with_position(df, ["x", "id"], ranges=9).toPandas().sort_values("pos")
    want = df.toPandas().sort_values(["x", "id"])
    assert got["pos"].tolist() == list(range(5000))
    assert got["id"].tolist() == want["id"].tolist()
    sizes = ordering.with_sort_range(df, "x", "r", 9).groupBy("r").count().toPandas()
    assert (sizes["count"] > 2000).sum() == 1


@pytest.mark.parametrize("block", [3, 17, 100_000])
def test_windows_do_not_depend_on_blocks(spark, block):
    df = spark.range(10).select(
        F.col("id").alias("t"),
        (F.col("id") * F.col("id")).cast("double").alias("x"),
        F.when(F.col("id") == 5, "Attack").otherwise("Normal").alias("label"),
    )
    rows = timeseries.sliding_windows(df, ["x"], "label", ["t"], 4, 3, block_rows=block).toPandas()
    rows = rows.sort_values("window_id")
    assert rows["window_id"].tolist() == [0, 1, 2]
    squares = np.arange(10.0) ** 2
    for i, start in enumerate((0, 3, 6)):
        part = squares[start : start + 4]
        row = rows.iloc[i]
        assert row["x_mean"] == pytest.approx(part.mean())
        assert row["x_std"] == pytest.approx(part.std())
        assert row["x_delta"] == part[-1] - part[0]
    assert rows["label"].tolist() == ["Normal", "Attack", "Normal"]


def test_medians_by_narrowing_brackets(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "BRACKET_ROWS", 50)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=4001), np.repeat([1.0, 2.0], 2000).tolist() + [2.0]
    z = [None if i % 3 else float(v) for i, v in enumerate(rng.exponential(size=4001))]
    df = spark.createDataFrame(list(zip(x.tolist(), y, z)), "x double, y double, z double")
    got = cleaning.exact_medians(df, ["x", "y", "z"])
    assert got["x"] == pytest.approx(np.median(x))
    assert got["y"] == np.median(y)
    assert got["z"] == pytest.approx(np.median([v for v in z if v is not None]))


@pytest.mark.parametrize("grouped, skip", [(False, False), (True, True)])
def test_neighbours_over_many_cells_and_blocks(spark, grouped, skip):
    rng = np.random.default_rng(0)
    # a hot cluster with most points, and a few loose ones
    x = np.concatenate([rng.normal(0, 0.05, (500, 4)), rng.normal(0, 3, (200, 4))])
    labels = ["a" if i % 3 else "b" for i in range(len(x))]
    df = spark.createDataFrame(
        [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, labels))],
        "id long, vector array<double>, label string",
    )
    got = neighbours.nearest(
        df, df, 5, group="label" if grouped else None, skip_self=skip, point_block=37, query_block=23
    ).toPandas()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    if grouped:
        same = np.array(labels)[:, None] == np.array(labels)[None]
        dist = np.where(same, dist, np.inf)
    if skip:
        np.fill_diagonal(dist, np.inf)
    want = np.sort(dist, axis=1)[:, :5]
    table = got.sort_values(["id", "rank"])["distance"].to_numpy().reshape(len(x), 5)
    assert np.allclose(table, want)


def test_smote_points_lie_between_same_class_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), "big" if i < 60 else "small") for i in range(75)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    made = oversampling.smote(df, "label").toPandas()
    assert made.groupby("label").size().to_dict() == {"big": 60, "small": 60}
    by_id = {i: np.array(v) for i, v, _ in rows}
    new = made[made["copy"].notna()]
    assert set(new["label"]) == {"small"}
    for _, r in new.iterrows():
        a, b, p = by_id[int(r["base"])], by_id[int(r["neighbour"])], np.array(r["vector"])
        assert int(r["neighbour"]) >= 60 and r["neighbour"] != r["base"]
        gap = (p - a) @ (b - a) / ((b - a) @ (b - a))
        assert -1e-9 <= gap <= 1 and np.allclose(a + gap * (b - a), p)


def test_score_curve_over_ranges_matches_pairs(spark):
    rng = np.random.default_rng(2)
    score = np.round(rng.random(600), 2)
    truth = rng.random(600) < score
    df = spark.createDataFrame(
        [(float(s), "Attack" if t else "Normal") for s, t in zip(score, truth)], "score double, y string"
    ).withColumn("run", F.lit(1))
    row = scoring.area_metrics(scoring.score_curve(df, ["run"], F.col("y") == "Attack"), ["run"]).first()
    pos, neg = score[truth], score[~truth]
    pairs = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert row["auroc"] == pytest.approx(pairs)


def test_one_class_has_no_auroc(spark):
    df = spark.range(5).select(F.lit(1).alias("run"), F.col("id").cast("double").alias("score"))
    row = scoring.area_metrics(scoring.score_curve(df, ["run"], F.lit(False)), ["run"]).first()
    assert row["auroc"] is None and row["auprc"] is None


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(40).select(F.lit("a").alias("g"), "id", (F.col("id") % 7).cast("double").alias("x"))
    row = bootstrap_interval(df, ["g"], "x", "id", resamples=300).first()
    assert row["lo"] < row["mean"] < row["hi"] and row["n"] == 40


def test_positions_keep_rows_without_group_or_key(spark):
    rows = [(None, 1.0), (None, None), ("a", 2.0), ("a", None), ("a", 1.0), (None, 0.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = ordering.with_position(df, ["x"], ["g"], ranges=3).collect()
    assert sorted((r["g"] or "", r["pos"], r["x"] or -1.0) for r in got) == [
        ("", 0, -1.0), ("", 1, 0.5), ("", 2, 1.0), ("a", 0, -1.0), ("a", 1, 1.0), ("a", 2, 2.0),
    ]


def test_empty_inputs_give_empty_results(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>, label string")
    assert neighbours.nearest(empty, empty, 3).count() == 0
    assert ordering.with_position(empty, ["id"]).count() == 0
    assert sampling.uniform_sample(empty, 5, ["id"]).count() == 0
    assert sampling.prevalence_sample(empty, "label", 5, ["id"]).count() == 0


def test_one_vs_rest_computes_its_rows_once(spark):
    rng = np.random.default_rng(5)
    share = rng.dirichlet(np.ones(3), 300)
    truth = [str(t) for t in (share + rng.normal(0, 0.3, share.shape)).argmax(1)]
    data = [("m", t, {str(c): float(v) for c, v in enumerate(p)}) for t, p in zip(truth, share)]
    data += [("m", "0", None), ("m", "1", {}), ("m", "2", {"0": None, "1": None, "2": None})]
    schema = "run string, y_true string, proba map<string,double>"
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(data, schema).mapInArrow(count, schema)
    row = scoring.auroc_one_vs_rest(df, ["run"], "proba").first()
    want = []
    for c in range(3):
        mine = np.array([t == str(c) for t in truth])
        want.append((share[mine, c][:, None] > share[~mine, c][None]).mean())
    assert row["auroc_ovr"] == pytest.approx(np.mean(want)) and row["n_classes"] == 3
    assert seen.value == len(data)


@pytest.mark.parametrize("kind", ["random", "ties", "close", "huge"])
@pytest.mark.parametrize("skip", [False, True])
def test_block_pairs_by_products_match_measured_distances(monkeypatch, kind, skip):
    """Few pairs are measured, and these decide as if all were; ids repeat."""
    monkeypatch.setattr(neighbours, "TILE", 20_000)
    rng = np.random.default_rng(7)
    make = {
        "random": lambda n: rng.normal(size=(n, 64)),
        "ties": lambda n: rng.integers(0, 2, (n, 4)).astype(float),
        "close": lambda n: 1e3 + 1e-9 * rng.normal(size=(n, 8)),
        "huge": lambda n: 1e155 * rng.integers(0, 2, (n, 3)),
    }[kind]
    b = make(700)
    a = np.vstack([b[:20], make(30)])
    ids, asked = rng.integers(0, 300, len(b)), rng.integers(0, 300, len(a))
    same = neighbours._pairs_of_same_id(pd.Series(asked), pd.Series(ids)) if skip else None
    rows, cols, dist = neighbours._smallest(a, b, ids, 8, same)
    with np.errstate(over="ignore"):
        every = neighbours._distances(a, b)
    if skip:
        every[asked[:, None] == ids[None]] = np.inf
    order = [np.lexsort((ids, d))[:8] for d in every]
    want = [(i, ids[c], every[i, c]) for i, near in enumerate(order) for c in near if np.isfinite(every[i, c])]
    assert list(zip(rows, ids[cols], dist)) == want
    if kind == "random":
        assert sum(len(c) for _, _, _, c in neighbours._near_pairs(a, b, 8, same)) < 3 * 8 * len(a)


def test_neighbour_blocks_follow_the_sizes():
    """Copies of the vectors: blocks of the other side; these stay few while the tables grow."""
    for n in (10_000, 60_000, 500_000):
        assert -(-n // neighbours._block(n, None, neighbours.POINT_BLOCKS)) <= 16
    assert neighbours._block(10**7, None, neighbours.POINT_BLOCKS) == 32_768
    assert neighbours._block(10**7, 37, neighbours.POINT_BLOCKS) == 37


def test_vectors_without_numbers_have_no_neighbours(spark):
    rows = [(i, [float(i), 0.0], "a") for i in range(40)] + [(50, [float("inf"), 0.0], "a")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    queries = df.where("id IN (0, 50)")
    got = neighbours.nearest(df.where("id < 50"), queries, 3, skip_self=True, keep=["label"]).collect()
    assert sorted((r.id, r.rank, r.neighbour, r.distance) for r in got) == [(0, k, k, float(k)) for k in (1, 2, 3)]
