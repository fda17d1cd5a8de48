"""Synthetic minority rows (SMOTE, borderline SMOTE, ADASYN) over a vector column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridvigil.functions.bounded import collect_bounded, local_table, materialise
from gridvigil.functions.hashing import draw_number, row_digest, unit_draw
from gridvigil.operators.neighbours import nearest
from gridvigil.operators.sampling import MAX_STRATA, class_counts, mark_lowest, with_draw

# --- fixed values: neighbours of the three methods ---
K_NEIGHBOURS = 5
BORDERLINE_NEIGHBOURS = 10
#: copies of one row made by one task
COPY_CHUNK = 10_000


def _sizes(df: DataFrame, label: str) -> dict:
    rows = collect_bounded(class_counts(df, [label]), MAX_STRATA)
    if rows is None:
        raise ValueError(f"more than {MAX_STRATA} classes")
    return {r[0]: r["n"] for r in rows}


def _lookup(df: DataFrame, label: str, values: dict, name: str) -> DataFrame:
    schema = df.select(label).schema.add(name, "long")
    return df.join(local_table(df.sparkSession, list(values.items()), schema), label)


def _spread_evenly(bases: DataFrame, label: str, id_col: str, missing: dict, seed: int) -> DataFrame:
    """Add ``copies``: the missing rows of a class shared evenly over its base rows.

    The remainder goes to the first rows in hash order.
    """
    sizes = _sizes(bases, label)
    drawn = with_draw(bases, [id_col], seed)
    rest = {c: missing[c] % n for c, n in sizes.items()}
    whole = {c: missing[c] // n for c, n in sizes.items()}
    spark = bases.sparkSession
    schema = bases.select(label).schema.add("target", "long")
    targets = local_table(spark, list(rest.items()), schema)
    extra = mark_lowest(
        drawn, [label], lambda counts: counts.join(targets, label), out="_extra"
    )
    return _lookup(extra, label, whole, "_whole").withColumn(
        "copies", F.col("_whole") + F.col("_extra").cast("long")
    ).drop("_whole", "_extra", "draw", "digest")


def _interpolate(
    bases: DataFrame, points: DataFrame, label: str, id_col: str, vector: str, k: int, seed: int
) -> DataFrame:
    """New rows between a base row and a random one of its k same-class neighbours."""
    wanted = bases.where(F.col("copies") > 0)
    found = nearest(points, wanted, k, id_col, id_col, vector, group=label, skip_self=True)
    lists = found.groupBy(id_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"])
        .alias("_near")
    )
    # Two steps, so the copies of one row of a tiny class are made by many tasks.
    chunks = (
        wanted.join(lists, id_col)
        .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPY_CHUNK})")))
        .repartition(id_col, "_chunk")
    )
    last = F.least(F.col("copies"), (F.col("_chunk") + 1) * COPY_CHUNK) - 1
    copies = chunks.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * COPY_CHUNK, last)))
    pick = draw_number(row_digest(seed, id_col, "copy")) % F.size("_near")
    chosen = copies.withColumn("_nid", F.element_at("_near", (pick + 1).cast("int"))).withColumn(
        "_gap", unit_draw(row_digest(seed + 1, id_col, "copy"))
    )
    ends = points.select(
        F.col(id_col).alias("_nid"), F.col(vector).cast("array<double>").alias("_end")
    )
    made = F.zip_with(
        F.col(vector).cast("array<double>"), "_end", lambda a, b: a + F.col("_gap") * (b - a)
    )
    return chosen.join(ends, "_nid").select(
        F.col(id_col).alias("base"), "copy", F.col("_nid").alias("neighbour"), label,
        made.alias(vector),
    )


def _with_originals(df: DataFrame, new: DataFrame, label: str, id_col: str, vector: str) -> DataFrame:
    """(base, copy, neighbour, label, vector); originals have no copy number."""
    old = df.select(
        F.col(id_col).alias("base"), label, F.col(vector).cast("array<double>").alias(vector)
    )
    return old.unionByName(new, allowMissingColumns=True)


def _neighbour_count(sizes: dict) -> int:
    return max(1, min(K_NEIGHBOURS, min(sizes.values()) - 1))


def _other_share(
    points: DataFrame, rows: DataFrame, label: str, id_col: str, vector: str, k: int
) -> DataFrame:
    """``rows`` with the share of their k nearest points that have another label."""
    tagged = points.select(id_col, vector, F.col(label).alias("_other"))
    found = nearest(tagged, rows, k, id_col, id_col, vector, skip_self=True, keep=["_other"])
    joined = found.join(rows.select(id_col, label), id_col)
    share: Column = F.avg((F.col("_other") != F.col(label)).cast("int"))
    return rows.join(joined.groupBy(id_col).agg(share.alias("other_share")), id_col)


def smote(
    df: DataFrame, label: str, id_col: str = "id", vector: str = "vector", seed: int = 42
) -> DataFrame:
    """Every class grown to the size of the largest."""
    sizes = _sizes(df, label)
    top = max(sizes.values())
    missing = {c: top - n for c, n in sizes.items()}
    small = df.where(F.col(label).isin([c for c, m in missing.items() if m > 0]))
    bases = _spread_evenly(small, label, id_col, missing, seed)
    new = _interpolate(bases, df, label, id_col, vector, _neighbour_count(sizes), seed)
    return _with_originals(df, new, label, id_col, vector)


def borderline_smote(
    df: DataFrame, label: str, id_col: str = "id", vector: str = "vector", seed: int = 42
) -> DataFrame:
    """Only rows in danger grow: at least half, not all, of their neighbours are of other classes.

    A class without such rows stays as it is.
    """
    sizes = _sizes(df, label)
    top = max(sizes.values())
    missing = {c: top - n for c, n in sizes.items()}
    small = df.where(F.col(label).isin([c for c, m in missing.items() if m > 0]))
    shared = _other_share(df, small, label, id_col, vector, BORDERLINE_NEIGHBOURS)
    danger = materialise(
        shared.where((F.col("other_share") >= 0.5) & (F.col("other_share") < 1.0)).drop("other_share")
    )
    bases = _spread_evenly(danger, label, id_col, missing, seed)
    new = _interpolate(bases, df, label, id_col, vector, _neighbour_count(sizes), seed)
    return _with_originals(df, new, label, id_col, vector)


def adasyn(
    df: DataFrame, label: str, id_col: str = "id", vector: str = "vector", seed: int = 42
) -> DataFrame:
    """Copies in proportion to the share of other-class neighbours."""
    sizes = _sizes(df, label)
    top = max(sizes.values())
    missing = {c: top - n for c, n in sizes.items()}
    k = _neighbour_count(sizes)
    small = df.where(F.col(label).isin([c for c, m in missing.items() if m > 0]))
    shared = materialise(_other_share(df, small, label, id_col, vector, k))
    totals = {
        r[0]: r[1] for r in shared.groupBy(label).agg(F.sum("other_share")).collect()
    }
    factor = {c: missing[c] / t for c, t in totals.items() if t}
    schema = df.select(label).schema.add("_factor", "double")
    bases = shared.join(local_table(df.sparkSession, list(factor.items()), schema), label).withColumn(
        "copies", F.rint(F.col("other_share") * F.col("_factor")).cast("long")
    )
    new = _interpolate(bases, df, label, id_col, vector, k, seed)
    return _with_originals(df, new, label, id_col, vector)


METHODS = {"smote": smote, "borderline": borderline_smote, "adasyn": adasyn}


def balance(df: DataFrame, label: str, method: str = "smote", **columns) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    return METHODS[method](df, label, **columns)
