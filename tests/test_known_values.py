"""Cases with known answers."""

import dataclasses
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridvigil.functions import labels, statistics, texts
from gridvigil.operators import classifiers, cleaning, ensembles, features, reports, scoring
from gridvigil.plans.preparation import prepare
from gridvigil.sources import archives, datasets, files, tables


@pytest.mark.parametrize(
    "b, c, p",
    [
        (253, 472, 5.66e-16), (262, 696, 1.80e-44), (428, 432, 0.919), (137, 87, 1.06e-03),
        (228, 123, 2.84e-08), (364, 171, 1.03e-16), (18, 2, 4.02e-04), (15, 8, 0.210), (20, 14, 0.391),
    ],
)
def test_mcnemar(b, c, p):
    assert statistics.mcnemar_probability(b, c) == pytest.approx(p, rel=5e-3)


def test_mcnemar_without_disagreement():
    assert statistics.mcnemar_probability(0, 0) is None


@pytest.mark.parametrize("n1, n2", [(3, 4), (5, 5), (2, 8)])
def test_exact_rank_sum_by_enumeration(n1, n2):
    from itertools import combinations

    ranks = range(n1 + n2)
    counts = [sum(r > s for r in c for s in ranks if s not in c) for c in combinations(ranks, n1)]
    for u in range(n1 * n2 + 1):
        high = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= high for x in counts) / len(counts))
        assert statistics.exact_rank_sum_p(u, n1, n2) == pytest.approx(want)


def test_normal_rank_sum_with_ties():
    # n1 = n2 = 10, U = 20, no ties: z = (80 - 50 - 0.5) / sqrt(175)
    want = math.erfc(29.5 / math.sqrt(175) / math.sqrt(2))
    assert statistics.rank_sum_probability(20, 10, 10, 0.0) == pytest.approx(want)
    tied = statistics.rank_sum_probability(20, 10, 10, 60.0)
    assert tied < want


@pytest.mark.parametrize(
    "text, label",
    [
        ("The reading is consistent with Normal operation.", "Normal"),
        ("Sensors look manipulated -> Attack", "Attack"),
        ("After analysis, this is an Attack on stage P3", "Attack"),
        ("Final classification: Normal.", "Normal"),
        ("Cannot determine", None),
        ("Normal? No: Attack", "Attack"),
        ("Attacker", None),
        ("Normal", "Normal"),
        ("", None),
    ],
)
def test_last_label(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(texts.last_label(F.col("t"), ["Normal", "Attack"])).first()[0] == label


def test_longer_label_wins_at_the_same_place(spark):
    df = spark.createDataFrame([("it is DoS Flood",)], "t string")
    assert df.select(texts.last_label(F.col("t"), ["DoS", "DoS Flood"])).first()[0] == "DoS Flood"


@pytest.mark.parametrize("raw", ["A ttack", " Attack ", "A-ttack", "attack"])
def test_letters_only(spark, raw):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(labels.letters_only(F.col("t"))).first()[0] == "Attack"


def test_four_figures_like_c(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 1.0, -2.5, 911.85, 68425.0, 9999.5, 99995.0, 1e-5, 0.00012345, 123456789.0, 1e22, 0.1]
    values += (rng.normal(size=300) * 10.0 ** rng.integers(-7, 9, 300)).tolist()
    values += np.round(rng.random(300) * 1000, 2).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.withColumn("shown", texts.four_figures(F.array("x"))[0]).collect()
    assert [r["shown"] for r in rows] == [f"{r['x']:.4g}" for r in rows]


def test_standardise_known_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, flat double")
    scaler = features.fit_scaler(df, ["x", "flat"])
    assert scaler.means["x"] == pytest.approx(7 / 3)
    assert scaler.stds["x"] == pytest.approx(1.247219128924647)
    assert [r["flat"] for r in scaler.transform(df).collect()] == [0.0, 0.0, 0.0]


def test_components_are_uncorrelated_and_ordered(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    made = features.principal_components(df, ["a", "b", "c"], 5).toPandas().to_numpy()
    assert made.shape == (300, 3)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
    assert np.allclose(made.var(axis=0), values)
    assert np.allclose(np.corrcoef(made.T), np.eye(3), atol=1e-8)


def test_knn_information_finds_the_feature_that_matters(spark):
    df = spark.range(2000).select(
        "id",
        (F.hash("id") % 1000 / 1000).alias("noise"),
        ((F.col("id") % 2) * 5 + (F.hash("id", F.lit(1)) % 1000) / 1000).alias("good"),
        (F.col("id") % 2).cast("string").alias("y"),
    )
    mi = {r["feature"]: r["mi"] for r in features.knn_mutual_information(df, ["noise", "good"], "y", ["id"]).collect()}
    assert mi["good"] == pytest.approx(math.log(2), abs=0.02) and mi["noise"] < 0.05


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "y_true string, y_pred string").withColumn("run", F.lit(1))


def test_metrics_by_hand(spark):
    rows = [("Normal", "Normal")] * 50 + [("Normal", "Attack")] * 10 + [("Attack", "Attack")] * 30
    rows += [("Attack", "Normal")] * 10
    m = scoring.detection_metrics(scoring.confusion_counts(_pairs(spark, rows), ["run"]), ["run"]).first()
    assert m["accuracy"] == pytest.approx(0.8) and m["weighted_recall"] == pytest.approx(0.8)
    assert m["far"] == pytest.approx(10 / 60) and m["dr"] == pytest.approx(0.75)
    mcc = (30 * 50 - 10 * 10) / math.sqrt(40 * 40 * 60 * 60)
    assert m["mcc"] == pytest.approx(mcc)


def test_wrong_attack_type_still_counts_as_detected(spark):
    rows = [("DoS", "Recon"), ("DoS", None), ("DoS", "Normal")]
    m = scoring.detection_metrics(scoring.confusion_counts(_pairs(spark, rows), ["run"]), ["run"]).first()
    assert m["dr"] == pytest.approx(2 / 3) and m["far"] is None and m["mcc"] == 0.0


def test_macro_class_sets_differ_by_predicted_only_labels(spark):
    rows = [("Normal", "Normal"), ("Attack", None)]
    counts = scoring.confusion_counts(_pairs(spark, rows), ["run"])
    union = scoring.detection_metrics(counts, ["run"]).first()["macro_f1"]
    true = scoring.detection_metrics(counts, ["run"], class_set="true").first()["macro_f1"]
    assert union == pytest.approx(1 / 3) and true == pytest.approx(1 / 2)


def test_majority_vote_ties_go_to_the_first(spark):
    df = spark.createDataFrame(
        [(["b", "a", None, "a", "b"],), ([None, None],), (["x"],)], "candidates array<string>"
    )
    got = [r[0] for r in df.select(ensembles.majority_vote()).collect()]
    assert got == ["b", None, "x"]


def test_fallback_is_attack_for_binary_runs(spark):
    df = spark.createDataFrame(
        [("r1", "Normal", None), ("r1", "Attack", "Attack"), ("r2", "DoS", None), ("r2", "DoS", "x"), ("r2", "A", None)],
        "run string, y_true string, y_pred string",
    )
    got = {r["run"]: r["fallback"] for r in ensembles.fallback_label(df, ["run"]).collect()}
    assert got == {"r1": "Attack", "r2": "DoS"}


def test_headline_falls_back_to_single_seed(spark):
    schema = "dataset string, experiment string, model string, kind string, MCC double"
    rows = [("a", "E1", "m", "k", 0.1), ("a", "E7_anchor_full", "m", "k", 0.2)]
    single = reports.headline(spark.createDataFrame(rows, schema)).collect()
    assert [r["MCC"] for r in single] == [0.2]
    multi = rows + [("a", "E7_multiseed", "m", "k", 0.3)]
    assert [r["MCC"] for r in reports.headline(spark.createDataFrame(multi, schema)).collect()] == [0.3]


def test_pareto_keeps_record_highs(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 3.0, 0.7), ("d", 1.0, 0.6)], "model string, cost double, gain double"
    )
    assert [r["model"] for r in reports.pareto_frontier(df, "cost", "gain").orderBy("cost").collect()] == ["d", "c"]


def test_single_class_is_refused(spark):
    df = spark.createDataFrame([("a",), ("a",)], "label string")
    with pytest.raises(ValueError, match="single class"):
        cleaning.require_two_classes(df, "label")


def test_label_column_is_found_by_priority():
    assert cleaning.find_label([" Timestamp", "normal/attack ", "Label"], cleaning.SWAT_LABEL_NAMES) == "normal/attack "
    with pytest.raises(KeyError, match="pressure"):
        cleaning.find_label(["pressure"], cleaning.HAI_LABEL_NAMES)


def test_numeric_label_detection(spark):
    df = spark.createDataFrame([("0", "3", "5"), ("1", "4", "5"), (None, "5", "7")], "bit string, many string, two string")
    assert cleaning.find_binary_label(df, ["many", "two", "bit"]) == "bit"
    assert cleaning.find_categorical_label(df, ["bit", "two", "many"]) == "many"


def test_model_round_trip(spark, tmp_path):
    df = spark.range(200).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 4, "Attack").otherwise("Normal").alias("label")
    )
    detector = classifiers.fit(df, ["x"], "label", classifiers.forest(numTrees=5, maxDepth=3))
    scored = detector.predict(df)
    assert scored.where("y_pred <> label").count() == 0
    share = scored.select(classifiers.attack_score().alias("s"), classifiers.confidence().alias("c")).first()
    assert 0 <= share["s"] <= 1 and share["c"] >= 0.5
    detector.save(str(tmp_path / "model"))
    again = classifiers.Detector.load(str(tmp_path / "model")).predict(df)
    assert again.where("y_pred <> label").count() == 0


def test_swat_folder_is_loaded(spark, tmp_path):
    (tmp_path / "_MACOSX").mkdir()
    (tmp_path / "_MACOSX" / "x.csv").write_text("junk\n")
    (tmp_path / "normal.csv").write_text(
        " Timestamp;LIT101 ;P101;Normal/Attack\n1;1,5;1;Normal\n2;2,5;2;Normal\n3;bad;2;Normal\n"
    )
    (tmp_path / "attack.csv").write_text("Timestamp,LIT101,P101,Normal/Attack\n4,3.5,2,A ttack\n5,-4.5,1,Attack\n")
    rows = datasets.load(spark, "swat", str(tmp_path)).orderBy("LIT101").collect()
    assert [(r["LIT101"], r["P101"], r["label"]) for r in rows] == [
        (-4.5, 1.0, "Attack"), (1.5, 1.0, "Normal"), (2.5, 2.0, "Normal"), (3.5, 2.0, "Attack"),
    ]


def test_version_folder_is_preferred(spark, tmp_path):
    for name in ("hai-20.07", "hai_21.03"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "train1.csv").write_text("time,P1_X,attack\n1,2,0\n")
        (tmp_path / name / "HAIEnd1.csv").write_text("time\n1\n")
    found = files.find_files(spark, str(tmp_path), preferred=["hai-21.03"])
    assert [os.path.basename(os.path.dirname(p)) for p in found] == ["hai_21.03"]
    with pytest.raises(FileNotFoundError):
        files.find_files(spark, str(tmp_path), "*.xlsx")


def test_prepare_windows_and_scales(spark):
    df = spark.range(40).select(
        F.col("id").alias("t"),
        F.when(F.col("id") != 3, (F.col("id") % 8).cast("double")).alias("x"),
        F.lit(1.0).alias("fixed"),
        F.when(F.col("id") > 30, "Attack").otherwise("Normal").alias("label"),
    )
    config = datasets.DatasetConfig("t", window_size=4, window_stride=2, remove_duplicates=False, pca=True, pca_components=2)
    made = prepare(df, config, order_cols=["t"])
    assert set(made.columns) == {"label", "window_id", "PC1", "PC2"}
    assert made.count() == 19


def test_zip_member_by_exact_then_base_name(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/run.csv", "x,y\n1,2\n")
        z.writestr("run.csv", "x,y\n3,4\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("deep/run.csv", "x,y\n5,6\n")
    (tmp_path / "c.zip").write_bytes(b"not a zip")
    lines = archives.member_lines(archives.read_archives(spark, str(tmp_path)), "run.csv")
    rows = archives.csv_rows(lines, "x int, y int").collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(3, 4), (5, 6)]


def test_unreadable_run_tables_are_skipped(spark, tmp_path):
    folder = tmp_path / "binary"
    folder.mkdir()
    (folder / "e1_swat.csv").write_text("model,mcc\na,0.5\nb,oops\n")
    rows = tables.read_runs(spark, str(folder / "*.csv"), "model string, mcc double").collect()
    found = [(r["dataset"], r["mode"], r["model"], r["mcc"]) for r in rows]
    assert found == [("swat", "binary", "a", 0.5), ("swat", "binary", "b", None)]


def write_file(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_given_separator_keeps_each_files_header(spark, tmp_path):
    paths = [write_file(tmp_path, "a.csv", "x,y\n10,20\n"), write_file(tmp_path, "b.csv", "y,x,z\n20,10,5\n")]
    rows = files.read_delimited(spark, paths, separator=",").select("x", "y").collect()
    assert {tuple(r) for r in rows} == {("10", "20")} and len(rows) == 2


def test_bad_result_rows_stay(spark, tmp_path):
    path = write_file(tmp_path, "run_binary_flow.csv", "model,mcc\na,0.5\nb,oops\n")
    rows = tables.read_runs(spark, path, "model string, mcc double").collect()
    assert {(r["model"], r["mcc"], r["dataset"]) for r in rows} == {("a", 0.5, "flow"), ("b", None, "flow")}


@pytest.mark.parametrize("case", [str.title, str.lower])
def test_flow_labels_are_found_and_dropped(spark, case):
    rows = [("0", "0", "1.5"), ("1", "1", "2.5"), ("1", "1", "3.5")]
    raw = spark.createDataFrame(rows, [case("target"), case("traffic"), "Rate"])
    for binary in (True, False):
        clean = datasets.clean_wustl(raw, dataclasses.replace(datasets.WUSTL, binary=binary))
        assert clean.columns == ["Rate", "label"]
        assert sorted(r["label"] for r in clean.collect()) == ["Attack", "Attack", "Normal"]


def test_class_list_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("x",), (None,)], "y string")
    coded = df.withColumn("code", labels.encoded(F.col("y"), ["b", "a"]))
    rows = coded.withColumn("back", labels.decoded(F.col("code"), ["b", "a"])).collect()
    assert [tuple(r) for r in rows] == [("b", 1, "b"), ("a", 0, "a"), ("x", None, None), (None, None, None)]


def test_few_lowest_equals_the_cut_off(spark):
    from gridvigil.operators import sampling

    rows = [(i % 40, ["a", None, "b"][i % 3], i // 7) for i in range(300)] + [(5, "a", 1)] * 9
    df = spark.createDataFrame(rows, "key int, label string, v int").repartition(7)
    drawn = sampling.with_draw(df, ["key"])
    for strata in (["label"], []):
        for size in (0, 1, 9, 50, 400):
            few = sampling.few_lowest(drawn, strata, size).drop("_place")
            whole = sampling.mark_lowest(drawn, strata, sampling.fixed_quota(size)).where("taken").drop("taken")
            assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))


def test_strata_that_python_cannot_compare(spark):
    from gridvigil.operators import sampling

    rows = [(i, float("nan") if i % 2 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "key int, label double")
    taken = sampling.pool_and_holdout(df, "label", ["key"], 0.3).where("part = 'holdout'")
    assert taken.count() == 30
