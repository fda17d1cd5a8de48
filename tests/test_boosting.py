"""Boosted trees against a booster that scans all rows of every node, by hand."""

import heapq
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridvigil.operators import boosting, classifiers
from gridvigil.operators.boosting import GRAIN, Boosting

FEATURES = ["a", "b.c", "d"]


def rows_of(n=240, seed=4, classes=("x", "y", "z")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randint(0, 9), rng.choice([0.5, 1.5, 2.5, None, float("nan")])
        d = rng.choice([-1.0, 0.0, 7.0]) if i % 40 else None
        label = classes[(a > 4) + (b is not None and b > 1 and len(classes) > 2)]
        if rng.random() < 0.15:
            label = rng.choice(classes)
        rows.append((i, float(a), b, d, label, 1.0 + (i % 3)))
    rows.append((n, 1.0, 1.0, 1.0, None, 1.0))  # no label
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, a double, `b.c` double, d double, label string, w double")


def booster_by_hand(rows, settings, weighted):
    rows = [r for r in rows if r[4] is not None]
    x = [[None if v is None or v != v else v for v in r[1:4]] for r in rows]
    labels = sorted({r[4] for r in rows})
    w = [r[5] if weighted else 1.0 for r in rows]
    total = [sum(wi for wi, r in zip(w, rows) if r[4] == c) for c in labels]
    logs = [math.log(t / sum(total)) for t in total]
    columns = [logs[1] - logs[0]] if len(labels) == 2 else logs
    scores = [list(columns) for _ in rows]
    values = [sorted({v[f] for v in x if v[f] is not None}) for f in range(3)]

    def grain(v):
        return round(v / GRAIN) * GRAIN  # half to even, as in NumPy

    def best(own, g, h):
        found = None
        G, H = sum(g[i] for i in own), sum(h[i] for i in own)
        for f in range(3):
            for cut in values[f]:
                for missing_left in (False, True):
                    if missing_left and all(x[i][f] is not None for i in own):
                        continue
                    left = [i for i in own if (missing_left if x[i][f] is None else x[i][f] <= cut)]
                    if not settings.min_rows <= len(left) <= len(own) - settings.min_rows or not 0 < len(left) < len(own):
                        continue
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if hl < settings.min_hessian or H - hl < settings.min_hessian:
                        continue
                    l2 = settings.l2 + 1e-12
                    gain = (gl * gl / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G * G / (H + l2)) / 2
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, cut, missing_left, left, sorted(set(own) - set(left)))
        return found

    all_splits = []
    for r in range(settings.rounds):
        change = [[0.0] * len(columns) for _ in rows]
        for t in range(len(columns)):
            g, h = [], []
            for s, row, wi in zip(scores, rows, w):
                if len(columns) == 1:
                    p = 1 / (1 + math.exp(-s[0]))
                    truth, hess = row[4] == labels[1], p * (1 - p)
                else:
                    e = [math.exp(v - max(s)) for v in s]
                    p = e[t] / sum(e)
                    truth, hess = row[4] == labels[t], 2 * p * (1 - p)
                g.append(grain((p - truth) * wi))
                h.append(grain(hess * wi))
            leaves, waiting, n = [], [], 0
            root = (list(range(len(rows))), 0)
            budget = settings.leaves or 1 << settings.depth
            heap = []

            def put(node):
                nonlocal n
                found = best(node[0], g, h) if node[1] < settings.depth else None
                n += 1
                heapq.heappush(heap, (-(found[0] if found else -1), n, node, found))

            put(root)
            n_leaves = 1
            while heap:
                _, _, node, found = heapq.heappop(heap)
                if found is None or n_leaves >= budget:
                    leaves.append(node[0])
                    continue
                n_leaves += 1
                all_splits.append((r, t, found[1], found[2], found[3]))
                put((found[4], node[1] + 1))
                put((found[5], node[1] + 1))
            for own in leaves:
                value = -sum(g[i] for i in own) / (sum(h[i] for i in own) + settings.l2 + 1e-12)
                for i in own:
                    change[i][t] = settings.rate * value
        for s, c in zip(scores, change):
            s[:] = [a + b for a, b in zip(s, c)]
    return rows, scores, sorted(all_splits)


def found_splits(model):
    return sorted(
        (r, t, f, float(model.edges[f][tree.cut[i]]), tree.missing_left[i])
        for r, trees in enumerate(model.rounds)
        for t, tree in enumerate(trees)
        for i, f in enumerate(tree.feature)
        if f >= 0
    )


CASES = {
    "levels": Boosting(rounds=3, depth=3, rate=0.3, bins=254, min_hessian=0.5),
    "best_first": Boosting(rounds=3, depth=6, rate=0.3, bins=254, leaves=5, l2=0.0, min_hessian=1e-3, min_rows=7),
    "shallow_best_first": Boosting(rounds=2, depth=2, rate=0.3, bins=254, leaves=9, l2=0.5, min_hessian=1e-3, min_rows=3),
}


@pytest.mark.parametrize("limits", [{}, {"PART": 50, "MAX_PASS": 20_000, "MAX_SUMS": 0, "INTERVAL": 1}, {"PART": 50, "MAX_PASS": 20_000, "INTERVAL": 2}])
@pytest.mark.parametrize("case", CASES)
def test_trees_by_hand(spark, monkeypatch, case, limits):
    for name, value in limits.items():
        monkeypatch.setattr(boosting, name, value)
    settings = CASES[case]
    rows = rows_of()
    model = boosting.fit(frame(spark, rows).repartition(3), FEATURES, "label", settings, "w")
    kept, scores, splits = booster_by_hand(rows, settings, True)
    # the last edge is no cut of a node, so the largest value of a feature never shows
    assert found_splits(model) == splits
    values = np.array([[np.nan if v is None else v for v in r[1:4]] for r in kept], float)
    assert np.allclose(model.scores(values), scores, atol=1e-9)
    if settings.leaves:
        assert all(t.n_leaves() <= settings.leaves for trees in model.rounds for t in trees)


def test_two_classes_share_a_tree(spark):
    settings = CASES["levels"]
    rows = rows_of(classes=("n", "y"))
    model = boosting.fit(frame(spark, rows), FEATURES, "label", settings)
    kept, scores, splits = booster_by_hand(rows, settings, False)
    assert all(len(trees) == 1 for trees in model.rounds)
    assert found_splits(model) == splits
    found = model.predict(frame(spark, rows)).collect()
    by_id = {r.id: r for r in found}
    for row, score in zip(kept, scores):
        p = 1 / (1 + math.exp(-score[0]))
        assert abs(by_id[row[0]].proba["y"] - p) < 1e-9
        assert by_id[row[0]].y_pred == ("y" if p > 0.5 else "n")


def test_smaller_child_is_scanned_and_passes_do_not_grow_with_classes(spark, monkeypatch):
    passes, scanned = [], []
    real = boosting._pass

    def counted(parts, since, growing, wanted, *rest):
        passes.append(len(growing))
        scanned.extend(wanted)
        return real(parts, since, growing, wanted, *rest)

    monkeypatch.setattr(boosting, "_pass", counted)
    settings = Boosting(rounds=1, depth=3, bins=100, min_hessian=0.0)
    for classes in (("x", "y", "z"), tuple("pqrstu")):
        passes.clear()
        scanned.clear()
        model = boosting.fit(frame(spark, rows_of(classes=classes)), FEATURES, "label", settings)
        assert len(passes) == settings.depth
        inner = sum(f >= 0 for t in model.rounds[0] for f in t.feature)
        looked = len(model.rounds[0])  # roots, and one child of each node above the last level
        depth_of = {}
        for t, tree in enumerate(model.rounds[0]):
            depth_of[t, 0] = 0
            for i, f in enumerate(tree.feature):
                if f >= 0:
                    depth_of[t, tree.left[i]] = depth_of[t, tree.right[i]] = depth_of[t, i] + 1
                    looked += depth_of[t, i] + 1 < settings.depth
        assert len(scanned) == looked < 2 * inner


def test_a_saved_booster_scores_the_same(spark, tmp_path):
    df = frame(spark, rows_of())
    model = classifiers.fit(df, FEATURES, "label", classifiers.leaf_boosting(rounds=2, min_rows=2))
    model.save(spark, str(tmp_path / "model"))
    again = boosting.BoostedDetector.load(spark, str(tmp_path / "model"))
    shown = [m.predict(df).select("id", "proba", "y_pred").orderBy("id").collect() for m in (model, again)]
    assert shown[0] == shown[1]
    assert model.predict(df.limit(0)).collect() == []


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError, match="single class"):
        boosting.fit(frame(spark, rows_of()).where("label = 'x'"), FEATURES, "label", Boosting(rounds=1))


def test_parts_of_a_batch_come_one_by_one():
    """A batch holds as many parts as Spark sends at once; a copy of them all would double a worker's memory."""
    n, size = 20, 20_000
    values = (np.arange(2 * size).astype(np.uint8), np.arange(size, dtype="<i4"), np.ones(size), np.arange(3.0 * size))
    columns = [pa.array([v.tobytes()] * n, pa.binary()) for v in values]
    batch = pa.RecordBatch.from_arrays(columns, names=["codes", "label", "weight", "scores"])
    tracemalloc.start()
    seen, before, most = 0, pa.total_allocated_bytes(), 0
    for part in boosting.parts_of(batch, 2, 3):
        assert all((got.ravel() == want).all() for got, want in zip(part, values, strict=True))
        most = max(most, pa.total_allocated_bytes() - before)
        seen += 1
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and most < batch.nbytes / 4


def test_forest_computes_its_rows_once(spark):
    data = [(float(i % 7), float(i % 5), "a" if i % 7 > 3 else "b") for i in range(200)]
    schema = "x double, y double, label string"
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(data, schema).mapInArrow(count, schema)
    detector = classifiers.fit(df, ["x", "y"], "label", classifiers.forest(numTrees=3, maxDepth=3))
    assert seen.value == len(data)
    assert detector.predict(spark.createDataFrame(data, schema)).where("y_pred = label").count() == len(data)
