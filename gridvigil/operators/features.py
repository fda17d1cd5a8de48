"""Scaling, principal components, feature ranking."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridvigil.functions.bounded import broadcast_if_small, local_table, materialise
from gridvigil.functions.hashing import hex_to_long, row_digest
from gridvigil.operators.neighbours import nearest
from gridvigil.operators.ordering import range_count
from gridvigil.operators.sampling import uniform_sample

# --- fixed values: feature budgets of the sweep ---
FEATURE_BUDGETS = [6, 8, 10, 12, 16, 20, "all"]


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations; a zero deviation only centres."""

    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(m)) / F.lit(self.stds[c] or 1.0)
                for c, m in self.means.items()
            }
        )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    return Scaler(
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(features)},
        {c: row[f"s{i}"] or 0.0 for i, c in enumerate(features)},
    )


def standardise(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scaled features; statistics from ``fit_on`` (default: all of ``df``)."""
    return fit_scaler(fit_on if fit_on is not None else df, features).transform(df)


@dataclass(frozen=True)
class Components:
    features: list[str]
    model: object
    signs: list[float]
    explained: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the (centred) features by PC1, PC2, …"""
        assembled = VectorAssembler(inputCols=self.features, outputCol="_vector").transform(df)
        projected = self.model.transform(assembled)
        parts = vector_to_array(F.col("_parts"))
        rest = [c for c in df.columns if c not in self.features]
        return projected.withColumn("_parts", parts).select(
            *rest,
            *[(F.col("_parts")[i] * s).alias(f"PC{i + 1}") for i, s in enumerate(self.signs)],
        )


def fit_components(df: DataFrame, features: Sequence[str], k: int) -> Components:
    """Principal components of centred features; the largest loading of each is positive.

    The covariance matrix is summed over the cluster; only features² numbers reach the
    driver. Keeps at most as many components as there are features or rows.
    """
    features = list(features)
    k = min(k, len(features), df.limit(k).count())
    assembled = VectorAssembler(inputCols=features, outputCol="_vector").transform(df)
    model = PCA(k=k, inputCol="_vector", outputCol="_parts").fit(assembled)
    loadings = model.pc.toArray()
    top = np.abs(loadings).argmax(axis=0)
    signs = [1.0 if loadings[row, i] >= 0 else -1.0 for i, row in enumerate(top)]
    return Components(features, model, signs, [float(v) for v in model.explainedVariance])


def principal_components(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    scaled = standardise(df, features)
    return fit_components(scaled, features, k).transform(scaled)


def align_feature_spaces(
    source: DataFrame,
    source_features: Sequence[str],
    target: DataFrame,
    target_features: Sequence[str],
    k: int = 25,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables scaled and projected, each by its own fit, to the same number of columns."""
    k = min(k, len(source_features), len(target_features))
    names = [f"PC{i + 1}" for i in range(k)]
    return (
        principal_components(source, source_features, k),
        principal_components(target, target_features, k),
        names,
    )


def class_separation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Centroid and spread of every class on the first two components."""
    flat = principal_components(df.select(*features, label), features, 2)
    return flat.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("PC1").alias("centre_1"),
        F.avg("PC2").alias("centre_2"),
        F.stddev_pop("PC1").alias("spread_1"),
        F.stddev_pop("PC2").alias("spread_2"),
    )


def neighbour_layout(
    df: DataFrame, features: Sequence[str], key: str, neighbours: int = 10, rounds: int = 12
) -> DataFrame:
    """A point (x, y) for every row, such that near neighbours lie together; other columns stay.

    The exact k-nearest-neighbour graph of the scaled features is taken both ways. From the
    first two principal components on, every round moves each point half-way to the mean of its
    neighbours, weighted by degree, and takes out the constant direction: power iteration to
    the normalised Laplacian's first two vectors. A round is one join of edges and points, and the
    points are kept in the checkpoint folder; the driver holds five sums. ``key`` is unique;
    rows need all features. Points without spread have x = y = 0.
    """
    features = list(features)
    rows = df.select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    names = [f"f{i}" for i in range(len(features))]
    scaled = standardise(rows, names)
    points = materialise(scaled.select("id", F.array(*names).alias("vector")))
    one_way = nearest(points, points, neighbours, skip_self=True).select("id", F.col("neighbour").alias("other"))
    both = one_way.unionByName(one_way.select(F.col("other").alias("id"), F.col("id").alias("other")))
    edges = materialise(both.distinct())
    degrees = edges.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("d"))
    flat = fit_components(scaled, names, 2).transform(scaled)
    second = F.col("PC2") if "PC2" in flat.columns else F.lit(0.0)
    state = flat.select("id", F.col("PC1").alias("a"), second.alias("b")).join(degrees, "id", "left")
    state = materialise(state.select("id", F.coalesce("d", F.lit(1.0)).alias("d"), "a", "b"))
    for _ in range(rounds):
        state = _clean_vectors(state)
        root = F.sqrt("d")
        sent = state.select(F.col("id").alias("other"), (F.col("a") / root).alias("a"), (F.col("b") / root).alias("b"))
        pulled = edges.join(sent, "other").groupBy("id").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
        zero = F.lit(0.0)
        state = materialise(
            state.join(pulled, "id", "left").select(
                "id", "d",
                (F.col("a") / 2 + F.coalesce("pa", zero) / root / 2).alias("a"),
                (F.col("b") / 2 + F.coalesce("pb", zero) / root / 2).alias("b"),
            )
        )
    state = _clean_vectors(state)
    places = state.select(F.col("id").alias("_id"), (F.col("a") / F.sqrt("d")).alias("x"), (F.col("b") / F.sqrt("d")).alias("y"))
    return df.join(places, F.col(f"`{key}`") == F.col("_id")).drop("_id")


def _clean_vectors(state: DataFrame) -> DataFrame:
    """Both vectors without the constant direction, the second without the first, of length 1."""
    root = F.sqrt("d")
    s = state.agg(
        F.sum(F.col("a") * root).alias("at"), F.sum(F.col("b") * root).alias("bt"), F.sum("d").alias("tt"),
        F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("b") * F.col("b")).alias("bb"),
    ).first()
    if not s["tt"]:
        return state
    ca, cb = s["at"] / s["tt"], s["bt"] / s["tt"]
    aa, ab, bb = s["aa"] - ca * s["at"], s["ab"] - ca * s["bt"], s["bb"] - cb * s["bt"]
    along = ab / aa if aa > 1e-18 else 0.0
    rest = bb - along * ab
    first = F.col("a") - ca * root
    second = F.col("b") - cb * root - along * first
    length = lambda square: F.lit(1 / math.sqrt(square) if square > 1e-18 else 0.0)
    return state.select("id", "d", (first * length(aa)).alias("a"), (second * length(rest)).alias("b"))


# --- mutual information ----------------------------------------------------------------------


def frequency_edges(
    df: DataFrame, features: Sequence[str], bins: int = 16, accuracy: int = 10_000
) -> dict[str, list[float]]:
    """Upper edges of equal-frequency bins, for all features in one pass."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(
        *[F.percentile_approx(f"`{c}`", shares, accuracy).alias(f"e{i}") for i, c in enumerate(features)]
    ).first()
    return {c: sorted({float(e) for e in row[i] or []}) for i, c in enumerate(features)}


def binned_mutual_information(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 16
) -> DataFrame:
    """(feature, mi) in nats on all rows: counts by (feature, bin, label), combined map-side."""
    edges = frequency_edges(df, features, bins)

    def bin_of(name: str):
        total = F.lit(0)
        for edge in edges[name]:
            total = total + (F.col(f"`{name}`") > edge).cast("int")
        return F.when(F.col(f"`{name}`").isNotNull(), total)

    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in features]
    )
    joint = (
        df.select(F.col(label).alias("_label"), F.inline(cells))
        .groupBy("feature", "bin", "_label")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    by = lambda *keys: F.sum("n").over(Window.partitionBy("feature", *keys))
    parts = joint.select(
        "feature", "n", by("bin").alias("n_bin"), by("_label").alias("n_label"), by().alias("n_all")
    )
    term = F.col("n") / F.col("n_all") * F.log(
        F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_label"))
    )
    return parts.groupBy("feature").agg(F.sum(term).alias("mi"))


#: rows of a sort range and of a block of neighbours in the nearest-neighbour estimate
RANGE_ROWS = 1 << 16
BLOCK_ROWS = 4096


def digamma(n: Column) -> Column:
    """psi(n) of whole n >= 1, by its series at n + 6."""
    far = n.cast("double") + 6
    square = 1 / (far * far)
    series = F.log(far) - 0.5 / far - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    for i in range(6):
        series = series - 1 / (n.cast("double") + i)
    return series


def _range_of(edges: dict[str, np.ndarray]):
    """Column function: in which range of its feature a value lies."""

    @F.pandas_udf("int")
    def find(feature: pd.Series, x: pd.Series) -> pd.Series:
        found = np.zeros(len(x), np.int32)
        names, values = feature.to_numpy(), x.to_numpy()
        for name in pd.unique(names):
            own = names == name
            found[own] = np.searchsorted(edges[name], values[own], side="left")
        return pd.Series(found)

    return find


def knn_mutual_information(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    neighbours: int = 3,
    sample_rows: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(feature, mi) by nearest neighbours (Ross 2014), on all rows or a uniform sample.

    A row's radius is the distance to its k-th nearest value of its own label: values are put
    in order, cut into blocks with ``neighbours`` copied rows on either side, and compared with
    the rows beside them. How many values of any label lie within the radius is the difference
    of two ranks: both ends are sorted among the values, range by range. No task gets more than
    a range of values or a block. Tiny noise from the keys' hash breaks ties, as the estimator
    assumes. Null and infinite values are left out, and a label's only row has no radius.
    """
    rows = df if sample_rows is None else uniform_sample(df, sample_rows, keys, seed)
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features]
    )
    digest = row_digest(seed, *keys)
    long = (
        rows.select(F.struct(*keys).alias("key"), digest.alias("digest"), F.col(label).cast("string").alias("y"), F.inline(cells))
        .na.drop(subset=["y", "x"])
        .where(F.abs("x") < float("inf"))
    )
    scale = F.stddev_pop("x")
    scales = long.groupBy("feature").agg(
        F.when(scale > 0, scale).otherwise(1.0).alias("scale"), F.avg(F.abs("x")).alias("size"), F.count(F.lit(1)).alias("n")
    ).collect()
    if not scales:
        return df.sparkSession.createDataFrame([], "feature string, mi double")
    table = local_table(df.sparkSession, [(r[0], r[1], max(1.0, r[2] / r[1])) for r in scales], "feature string, scale double, size double")
    own = F.md5(F.concat_ws(":", "digest", "feature"))
    noise = hex_to_long(own, 1, 13) / F.lit(float(16**13)) + hex_to_long(own, 14, 13) / F.lit(float(16**13)) - 1
    noised = long.join(table, "feature").select(
        "key", "feature", "y", (F.col("x") / F.col("scale") + F.lit(1e-10) * F.col("size") * noise).alias("x")
    )
    ranges = max(range_count(df), -(-max(r["n"] for r in scales) // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = noised.groupBy("feature").agg(F.percentile_approx("x", shares, max(1000, 4 * ranges)).alias("e")).collect()
    range_of = _range_of({r["feature"]: np.unique(np.array(r["e"], float)) for r in cuts})
    data = materialise(noised.withColumn("range", range_of("feature", "x")))

    sizes = data.groupBy("feature", "y", "range").agg(F.count(F.lit(1)).alias("n"))
    per_label = Window.partitionBy("feature", "y")
    earlier = per_label.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "feature", "y", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(per_label).alias("n_label")
    )
    inside = Window.partitionBy("feature", "y", "range").orderBy("x", "key")
    placed = (
        data.withColumn("rank", F.row_number().over(inside))
        .join(broadcast_if_small(offsets), ["feature", "y", "range"])
        .where(F.col("n_label") > 1)
        .withColumn("pos", F.col("offset") + F.col("rank") - 1)
    )
    block, place = F.expr(f"pos div {BLOCK_ROWS}"), F.col("pos") % BLOCK_ROWS
    copies = F.array_compact(F.array(
        block, F.when((place < neighbours) & (block > 0), block - 1), F.when(place >= BLOCK_ROWS - neighbours, block + 1)
    ))
    beside = Window.partitionBy("feature", "y", "block").orderBy("pos")
    steps = range(1, neighbours + 1)
    gaps = F.array(
        *[F.col("x") - F.lag("x", i).over(beside) for i in steps], *[F.lead("x", i).over(beside) - F.col("x") for i in steps]
    )
    k = F.least(F.lit(neighbours), F.col("n_label") - 1).cast("int")
    # just below the k-th distance, with room for the rounding of x ± radius
    radius = F.element_at(F.array_sort(gaps), k) - F.lit(1e-14) * F.greatest(F.lit(1.0), F.abs("x"))
    near = (
        placed.withColumn("block", F.explode(copies))
        .withColumn("radius", radius)
        .where(F.col("block") == block)
        .select("key", "feature", "x", "radius", k.alias("k"), "n_label")
    )
    near = materialise(near)
    nothing = F.lit(None).cast(data.schema["key"].dataType)
    ends = near.select(
        "key", "feature",
        F.inline(F.array(
            F.struct((F.col("x") - F.col("radius")).alias("x"), F.lit(0).alias("kind")),
            F.struct((F.col("x") + F.col("radius")).alias("x"), F.lit(2).alias("kind")),
        )),
    ).withColumn("range", range_of("feature", "x"))
    values = data.select(nothing.alias("key"), "feature", "x", F.lit(1).alias("kind"), "range")
    is_value = (F.col("kind") == 1).cast("long")
    up_to = Window.partitionBy("feature", "range").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.unionByName(ends).withColumn("below", F.sum(is_value).over(up_to)).where(F.col("kind") != 1)
    per_range = sizes.groupBy("feature", "range").agg(F.sum("n").alias("n"))
    # a range with ends alone has no row here: its offset is that of the last range before it
    spans = per_range.select(
        "feature", F.col("range").alias("from"),
        F.lead("range", 1, 1 << 30).over(Window.partitionBy("feature").orderBy("range")).alias("to"),
        F.sum("n").over(Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        "n",
    )
    every = spans.select(
        "feature", F.explode(F.sequence(F.col("from"), F.least(F.col("to") - 1, F.lit(ranges)))).alias("range"), "from",
        F.coalesce("before", F.lit(0)).alias("before"), "n",
    ).withColumn("offset", F.when(F.col("range") == F.col("from"), F.col("before")).otherwise(F.col("before") + F.col("n")))
    ranked = counted.join(broadcast_if_small(every.select("feature", "range", "offset")), ["feature", "range"], "left")
    count = F.col("below") + F.coalesce("offset", F.lit(0))
    within = ranked.groupBy("feature", "key").agg(
        (F.sum(F.when(F.col("kind") == 2, count)) - F.sum(F.when(F.col("kind") == 0, count))).alias("within")
    )
    terms = near.join(within, ["feature", "key"])
    mi = (
        digamma(F.count(F.lit(1))) + F.avg(digamma(F.col("k"))) - F.avg(digamma(F.col("n_label")))
        - F.avg(digamma(F.greatest(F.lit(1), "within")))
    )
    found = terms.groupBy("feature").agg(F.greatest(F.lit(0.0), mi).alias("mi"))
    names = local_table(df.sparkSession, [(r["feature"],) for r in scales], "feature string")
    return names.join(found, "feature", "left").na.fill(0.0, ["mi"])


def top_features(scores: DataFrame, k: int | str) -> DataFrame:
    ranked = scores.orderBy(F.desc("mi"), "feature")
    return ranked if k == "all" else ranked.limit(int(k))


