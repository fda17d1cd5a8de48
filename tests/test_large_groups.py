"""Paths for groups that are too large for one task, forced on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridvigil.operators import comparison, features, ordering, prompts, reports


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("group", [["g"], []])
def test_pareto_frontier(spark, monkeypatch, few, group):
    monkeypatch.setattr(reports, "FEW_ROWS", few)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"m{i}", float(rng.choice([1, 1, 1, 2, 3, 5, 8, i])), rng.random()) for i in range(400)]
    rows += [("a", "none", None, 9.0), ("a", "none", 0.0, None), ("c", "low", 1.0, -2.0)]
    df = spark.createDataFrame(rows, "g string, model string, cost double, gain double").repartition(5)
    want = set()
    for g in {r[0] for r in rows} if group else [0]:
        best = -1.0
        own = [r for r in rows if (not group or r[0] == g) and r[2] is not None and r[3] is not None]
        for r in sorted(own, key=lambda r: (r[2], -r[3], r[1])):
            if r[3] > best:
                want.add(r)
                best = r[3]
    assert {tuple(r) for r in reports.pareto_frontier(df, "cost", "gain", group).collect()} == want


def test_weighted_resamples_by_hand(spark, monkeypatch):
    monkeypatch.setattr(comparison, "FEW_VALUES", 30)
    monkeypatch.setattr(comparison, "WEIGHT_ROWS", 7)
    monkeypatch.setattr(comparison, "MAX_HELD", 100)
    rng = random.Random(8)
    rows = [("big", i, rng.gauss(5, 2)) for i in range(900)] + [(None, i, rng.random()) for i in range(200)]
    rows += [("small", i, float(i)) for i in range(9)] + [("big", 5000, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    found = {r.k: r for r in comparison.bootstrap_interval(df.repartition(6), ["k"], "x", "i", 300).collect()}
    again = {r.k: r for r in comparison.bootstrap_interval(df.coalesce(1), ["k"], "x", "i", 300).collect()}
    assert set(found) == {"big", None, "small"}
    table = comparison.poisson_table()
    for key in ("big", None):
        own = [r for r in rows if r[0] == key and r[2] is not None]
        ids = spark.createDataFrame([(r[1],) for r in own], "i int").select("i", F.xxhash64(F.lit(0), "i").alias("h")).collect()
        hashes = {r.i: r.h for r in ids}
        x = np.array([r[2] for r in own])
        w = comparison.weights_of(np.array([hashes[r[1]] for r in own], np.int64).view(np.uint64), 300, table)
        means = (x @ w) / w.sum(0)
        r = found[key]
        assert r.n == len(own) and math.isclose(r.mean, x.mean())
        assert math.isclose(r.lo, np.quantile(means, 0.025), rel_tol=1e-9) and math.isclose(r.hi, np.quantile(means, 0.975), rel_tol=1e-9)
        assert math.isclose(again[key].lo, r.lo, rel_tol=1e-12)
        error = x.std() / math.sqrt(len(x))  # the interval of a mean
        assert 1.5 * error < x.mean() - r.lo < 2.5 * error and 1.5 * error < r.hi - x.mean() < 2.5 * error


def test_poisson_weights():
    table = comparison.poisson_table()
    assert abs(table.mean() - 1) < 1e-3 and abs(table.astype(float).var() - 1) < 2e-3
    weights = comparison.weights_of(np.arange(2000, dtype=np.uint64) * np.uint64(77), 401, table)
    assert weights.shape == (2000, 401) and abs(weights.mean() - 1) < 0.01
    assert np.abs(np.corrcoef(weights[:, :40].T) - np.eye(40)).max() < 0.12


def test_positions_of_text_tuples(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot/path", "hot/path", "hot/path", "zz", "", None]), i, rng.choice(["x", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "path string, line int, g string").repartition(4)
    first = lambda r: (r[0] is not None, r[0] or "", r[1])
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=first))}
    found = ordering.with_position(df, ["path", "line"], ranges=8)
    assert {r.line: r.pos for r in found.collect()} == want
    # the hot path does not stay in one range
    sizes = ordering.materialise(df.repartitionByRange(8, "path", "line")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 200
    for g in ("x", None):
        own = sorted((r for r in rows if r[2] == g), key=first)
        found = ordering.with_position(df, ["path", "line"], ["g"], ranges=8).where(F.col("g").eqNullSafe(F.lit(g)))
        assert {r.line: r.pos for r in found.collect()} == {r[1]: n for n, r in enumerate(own)}


def test_answers_outlive_a_failed_run(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(prompts, "ASK_ROWS", 10)
    store = str(tmp_path / "store")
    rows = [(i, f"q{i % 50}" if i else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, request string")
    asked = []

    def score(once, fail_at=None, name="a"):
        keys = [r.request for r in once.collect()]
        asked.append(len(keys))
        if fail_at is not None and len(asked) > fail_at:
            raise RuntimeError("the endpoint is gone")
        return once.withColumn("answer", F.concat("request", F.lit(name)))

    with pytest.raises(RuntimeError):
        prompts.score_distinct(df, "request", lambda once: score(once, 2), store=store)
    kept = sum(asked[:2])
    asked.clear()
    whole = prompts.score_distinct(df, "request", lambda once: score(once, name="b"), store=store).collect()
    assert sum(asked) == 50 - kept and len(whole) == 199
    assert len({r.request for r in whole if r.answer.endswith("a")}) == kept
    asked.clear()
    assert sorted(prompts.score_distinct(df, "request", score, store=store).collect()) == sorted(whole)
    assert asked == []
    assert prompts.score_distinct(df.limit(0), "request", score, store=str(tmp_path / "new")).collect() == []


def test_knn_information_in_small_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), float(rng.choice([0, 0, 0, 1, rng.random()])), rng.gauss(0, 1), None) for i in range(300)]
    rows += [(300, "single", 0.5, 0.5, None), (301, None, 0.5, 0.5, None), (302, "a", None, float("nan"), 1.0), (303, "b", float("inf"), 2.0, None)]
    rows += [(304 + i, "two", 0.0, 5.0, None) for i in range(2)]
    df = spark.createDataFrame(rows, "id int, y string, ties double, `w.x` double, empty double").repartition(3)
    names = ["ties", "w.x", "empty"]
    whole = {r.feature: r.mi for r in features.knn_mutual_information(df, names, "y", ["id"]).collect()}
    assert set(whole) == {"ties", "w.x", "empty"} and whole["empty"] == 0
    monkeypatch.setattr(features, "BLOCK_ROWS", 8)
    monkeypatch.setattr(features, "RANGE_ROWS", 16)
    small = {r.feature: r.mi for r in features.knn_mutual_information(df, names, "y", ["id"]).collect()}
    assert small.keys() == whole.keys()
    assert all(math.isclose(small[f], whole[f], abs_tol=1e-12) for f in whole)
    assert features.knn_mutual_information(df.limit(0), names, "y", ["id"]).collect() == []


def layout_by_hand(x, k, rounds):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    a = np.zeros((len(x), len(x)))
    for i, row in enumerate(far):
        for j in np.lexsort((np.arange(len(x)), row))[:k]:
            a[i, j] = a[j, i] = 1
    d = a.sum(1)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    v = z @ vectors[:, ::-1][:, :2]
    top = np.abs(vectors[:, ::-1][:, :2]).argmax(0)
    v = v * np.sign(vectors[:, ::-1][top, [0, 1]])
    t = np.sqrt(d)

    def clean(v):
        v = v - np.outer(t, (t @ v) / (t @ t))
        first = v[:, 0] / np.linalg.norm(v[:, 0])
        second = v[:, 1] - first * (first @ v[:, 1])
        return np.stack([first, second / np.linalg.norm(second)], 1)

    for _ in range(rounds):
        v = clean(v)
        v = v / 2 + (a / np.sqrt(np.outer(d, d))) @ v / 2
    return clean(v) / t[:, None]


def test_neighbour_layout(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0]])
    x = np.concatenate([c + rng.normal(size=(25, 3)) for c in centres])
    rows = [(i, *map(float, v), "abc"[i // 25]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, p double, `q.r` double, s double, label string").repartition(4)
    found = features.neighbour_layout(df, ["p", "q.r", "s"], "id", neighbours=6, rounds=4)
    made = {r.id: (r.x, r.y) for r in found.collect()}
    assert np.allclose([made[i] for i in range(75)], layout_by_hand(x, 6, 4), atol=1e-8)
    places = np.array([made[i] for i in range(75)])
    means = np.stack([places[i * 25 : i * 25 + 25].mean(0) for i in range(3)])
    nearest = ((places[:, None] - means[None]) ** 2).sum(2).argmin(1)
    assert (nearest == np.arange(75) // 25).all()  # clusters apart stay apart
