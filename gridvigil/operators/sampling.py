"""Reproducible samples, splits and class weights.

Every random choice uses the hash order of ``functions.hashing``. A fixed quota of up to
``FEW`` rows a class is met in one job: every task keeps the lowest rows of each class, and
these few are merged. No larger quota ranks a whole class: ``cutoffs`` finds, by counting in ever narrower ranges, the key value at
which each class reaches its quota, and the sample is then a filter on the original scan with
no shuffle of the rows. A draw is uniform, so its first counting pass, which also counts the
classes, already tells the range. A null label is a class like any other. Of rows whose keys
are equal, as many are taken as the quota still allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridvigil.functions.bounded import collect_bounded, local_table, materialise
from gridvigil.functions.hashing import DRAW_DIGITS, draw_number, row_digest

#: most rows of a per-stratum table that is held on the driver and broadcast; a larger one
#: is written to the shared folder and joined by a shuffle
MAX_STRATA = 10_000
RANGES_PER_PASS = 4096
#: bits of a draw below the 256 parts of the first pass
DRAW_SHIFT = 4 * DRAW_DIGITS - 8
#: a boundary range with at most this many rows is ranked exactly
RANK_ROWS = 100_000

#: a fixed quota of at most so many rows is kept task by task; Spark limits a ranked group
#: before its shuffle below 1000 rows
FEW = 999
#: groups of tasks whose lowest rows are merged first, so that no task gets those of all tasks
TASK_GROUPS = 64

Quota = Callable[[DataFrame], DataFrame]


def with_draw(df: DataFrame, keys: Sequence[str], seed: int | Column = 42) -> DataFrame:
    """Add ``digest`` (md5 text) and ``draw`` (its leading 60 bits)."""
    return df.withColumn("digest", row_digest(seed, *keys)).withColumn(
        "draw", draw_number(F.col("digest"))
    )


def with_seeds(df: DataFrame, seeds: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """One copy of each row per seed, with its draw: all seeds are sampled in one job."""
    copies = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return with_draw(copies, keys, F.col("seed"))


def class_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


# --- selecting the lowest keys of each stratum -----------------------------------------


def _held(df: DataFrame) -> DataFrame:
    """A per-stratum table, computed once; broadcast when it is small."""
    rows = collect_bounded(df, MAX_STRATA)
    if rows is None:
        return materialise(df)
    return local_table(df.sparkSession, rows, _nullable(df.schema))


def _nullable(schema):
    for field in schema.fields:
        field.nullable = True
    return schema


def _per(strata: list[str]):
    return Window.partitionBy(*strata)


def join_strata(df: DataFrame, other: DataFrame, strata: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the strata, where null equals null; the strata come from ``df``."""
    renamed = {s: f"_stratum_{i}" for i, s in enumerate(strata)}
    condition = F.lit(True)
    for name, other_name in renamed.items():
        condition = condition & F.col(f"`{name}`").eqNullSafe(F.col(other_name))
    return df.join(other.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())


def cutoffs(
    df: DataFrame, strata: Sequence[str], quota: Quota, key: str = "draw", tie: str = "digest"
) -> DataFrame:
    """Per stratum where its quota ends: the strata, ``_cut_key``, ``_cut_tie`` (of the last
    row inside), ``_cut_take`` and ``_cut_same`` (how many of the rows with that key and tie
    are inside, and how many there are). The key is null where nothing is taken.

    ``quota`` adds ``target`` to the class counts (strata, n, ...). ``key`` is a long, ``tie``
    settles equal keys.
    """
    strata = list(strata)
    keyed = df.select(*strata, F.col(key).alias("_key"), F.col(tie).alias("_tie"))
    first = parts = None
    if key == "draw":
        split = keyed.groupBy(*strata, F.shiftright("_key", DRAW_SHIFT).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        parts = collect_bounded(split, MAX_STRATA)
        first = materialise(split) if parts is None else local_table(df.sparkSession, parts, _nullable(split.schema))
        counts = first.groupBy(*strata).agg(
            F.sum("_n").alias("n"), F.lit(0).cast("long").alias("_lo"), F.lit((1 << 4 * DRAW_DIGITS) - 1).alias("_hi")
        )
    else:
        counts = keyed.groupBy(*strata).agg(
            F.count(F.lit(1)).alias("n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")
        )
    wanted = quota(counts).select(*strata, "n", "_lo", "_hi", F.col("target").cast("long").alias("target"))
    rows = collect_bounded(wanted, MAX_STRATA)
    if rows is not None and (parts is not None or key != "draw"):
        return _few_strata(keyed, strata, rows, parts)
    goals = materialise(wanted)
    target = F.coalesce(F.col("target"), F.lit(0))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    nothing = goals.where(target <= 0).select(
        *strata, number.alias("_cut_key"), text.alias("_cut_tie"), number.alias("_cut_take"), number.alias("_cut_same")
    )
    zero = F.lit(0).cast("long")
    everything = goals.where((target > 0) & (target >= F.col("n"))).select(
        *strata, F.col("_hi").alias("_cut_key"), F.lit("\U0010ffff").alias("_cut_tie"), zero.alias("_cut_take"), zero.alias("_cut_same")
    )
    ranges = goals.where((target > 0) & (target < F.col("n"))).select(
        *strata, "_lo", "_hi", target.cast("long").alias("_need"), F.col("n").alias("_n")
    )
    if first is not None:
        parts = join_strata(first, ranges.drop("_n"), strata)
        ranges = _hit(parts, strata, F.lit(1 << DRAW_SHIFT))
    ranges = _held(ranges)
    wide = (F.col("_n") > RANK_ROWS) & (F.col("_hi") > F.col("_lo"))
    while ranges.where(wide).limit(1).count():
        ranges = _held(_narrow(keyed, strata, ranges))
    ranked = _ranked(keyed, strata, ranges)
    return _held(nothing.unionByName(everything).unionByName(ranked))


def _few_strata(keyed: DataFrame, strata: list[str], goals: list, parts: list | None) -> DataFrame:
    """``cutoffs`` where the driver holds the strata: a job for each narrowing and one for the rank."""
    spark = keyed.sparkSession
    kinds = _nullable(keyed.select(*strata).schema)
    cuts, ranges = [], []
    in_parts: dict[tuple, list] = {}
    for row in parts or []:
        in_parts.setdefault(repr([row[s] for s in strata]), []).append((row["_part"], row["_n"]))
    for row in goals:
        name, target = tuple(row[s] for s in strata), row["target"] or 0
        if target <= 0:
            cuts.append((*name, None, None, None, None))
        elif target >= row["n"]:
            cuts.append((*name, row["_hi"], "\U0010ffff", 0, 0))
        elif parts is None:
            ranges.append((*name, row["_lo"], row["_hi"], target, row["n"]))
        else:
            for part, n in sorted(in_parts[repr(list(name))]):
                if n >= target:
                    lo = part << DRAW_SHIFT
                    ranges.append((*name, lo, lo + (1 << DRAW_SHIFT) - 1, target, n))
                    break
                target -= n
    range_schema = StructType([*kinds.fields, *(StructField(n, LongType()) for n in ("_lo", "_hi", "_need", "_n"))])

    def held(found: list) -> DataFrame:
        return local_table(spark, found, range_schema)

    while any(r[-1] > RANK_ROWS and r[-3] > r[-4] for r in ranges):
        ranges = [tuple(r) for r in _narrow(keyed, strata, held(ranges)).collect()]
    if ranges:
        cuts += [tuple(r) for r in _ranked(keyed, strata, held(ranges)).collect()]
    names = (("_cut_key", LongType()), ("_cut_tie", StringType()), ("_cut_take", LongType()), ("_cut_same", LongType()))
    schema = StructType([*kinds.fields, *(StructField(n, t) for n, t in names)])
    found = local_table(spark, cuts, schema)
    found.splits = any(c[-2] is not None and c[-2] < c[-1] for c in cuts)
    return found


def _ranked(keyed: DataFrame, strata: list[str], ranges: DataFrame) -> DataFrame:
    order = _per(strata).orderBy("_key", "_tie")
    return (
        _inside(keyed, strata, ranges)
        .withColumn("_rn", F.row_number().over(order))
        .withColumn("_first", F.rank().over(order))
        .withColumn("_same", F.count(F.lit(1)).over(_per([*strata, "_key", "_tie"])))
        .where(F.col("_rn") == F.col("_need"))
        .select(
            *strata, F.col("_key").alias("_cut_key"), F.col("_tie").alias("_cut_tie"),
            (F.col("_need") - F.col("_first") + 1).cast("long").alias("_cut_take"), F.col("_same").alias("_cut_same"),
        )
    )


def _inside(keyed: DataFrame, strata: list[str], ranges: DataFrame) -> DataFrame:
    return join_strata(keyed, ranges, strata).where(F.col("_key").between(F.col("_lo"), F.col("_hi")))


def _narrow(keyed: DataFrame, strata: list[str], ranges: DataFrame) -> DataFrame:
    """One counting pass: replace each open range by the part that holds its quota."""
    parts = (
        _inside(keyed, strata, ranges)
        .withColumn("_part", F.expr(f"(_key - _lo) div ((_hi - _lo) div {RANGES_PER_PASS} + 1)"))
        .groupBy(*strata, "_lo", "_hi", "_need", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return _hit(parts, strata, F.expr(f"(_hi - _lo) div {RANGES_PER_PASS} + 1"))


def _hit(parts: DataFrame, strata: list[str], width: Column) -> DataFrame:
    """The part of each stratum's range in which its quota ends, as a range."""
    upto = _per(strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_lo") + F.col("_part") * width
    return (
        parts.withColumn("_cum", F.sum("_n").over(upto))
        .where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_n") < F.col("_need")))
        .select(
            *strata,
            start.alias("_lo"),
            F.least(start + width - 1, F.col("_hi")).alias("_hi"),
            (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_need"),
            "_n",
        )
    )


def mark_lowest(
    df: DataFrame,
    strata: Sequence[str],
    quota: Quota,
    key: str = "draw",
    tie: str = "digest",
    out: str = "taken",
) -> DataFrame:
    """Flag, per stratum, the ``target`` rows with the lowest (key, tie)."""
    if not strata:
        whole = df.withColumn("_whole", F.lit(0))
        return mark_lowest(whole, ["_whole"], quota, key, tie, out).drop("_whole")
    cuts = cutoffs(df, strata, quota, key, tie)
    split = cuts.splits if hasattr(cuts, "splits") else cuts.where("_cut_take < _cut_same").limit(1).count()
    joined = join_strata(df, cuts, strata, "left")
    equal = (F.col(key) == F.col("_cut_key")) & (F.col(tie) == F.col("_cut_tie"))
    below = (F.col(key) < F.col("_cut_key")) | ((F.col(key) == F.col("_cut_key")) & (F.col(tie) < F.col("_cut_tie")))
    if split:  # rows that cannot be told apart by their keys share what is left of a quota
        same = Window.partitionBy(*strata, key, tie).orderBy(_row_hash(df))
        joined = joined.withColumn("_place", F.when(equal, F.row_number().over(same)))
        equal = F.col("_place") <= F.col("_cut_take")
    flagged = joined.withColumn(out, F.coalesce(below | equal, F.lit(False)))
    return flagged.drop("_cut_key", "_cut_tie", "_cut_take", "_cut_same", "_place")


def _row_hash(df: DataFrame) -> Column:
    """Order of rows whose keys are equal."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])


def few_lowest(
    df: DataFrame, strata: Sequence[str], size: int, key: str = "draw", tie: str = "digest", out: str = "_place"
) -> DataFrame:
    """The ``size`` (at most ``FEW``) lowest rows per stratum with their rank ``out``, in one job.

    A task passes on no more than ``size`` rows of a stratum, a group of tasks as many.
    """
    if not 0 <= size <= FEW:
        raise ValueError(f"size must be 0 to {FEW}")
    # without strata all rows are one stratum, as in ``mark_lowest``
    order = (key, tie, _row_hash(df if strata else df.withColumn("_whole", F.lit(0))))
    near = Window.partitionBy(*strata, "_tasks").orderBy(*order)
    grouped = (df if strata else df.withColumn("_whole", F.lit(0))).withColumn("_tasks", F.spark_partition_id() % TASK_GROUPS)
    lowest = grouped.withColumn(out, F.row_number().over(near)).where(F.col(out) <= size).drop(out, "_tasks")
    whole = _per(list(strata)) if strata else _over(())
    found = lowest.withColumn(out, F.row_number().over(whole.orderBy(*order))).where(F.col(out) <= size)
    return found if strata else found.drop("_whole")


def take_lowest(df: DataFrame, strata: Sequence[str], quota: Quota, **keys) -> DataFrame:
    size = getattr(quota, "size", None)
    if size is not None and 0 <= size <= FEW:
        return few_lowest(df, strata, size, **keys).drop("_place")
    return mark_lowest(df, strata, quota, **keys).where("taken").drop("taken")


# --- quotas ---------------------------------------------------------------------------


def fixed_quota(size: int) -> Quota:
    def quota(counts: DataFrame) -> DataFrame:
        return counts.select("*", F.lit(size).cast("long").alias("target"))

    quota.size = size
    return quota


def share_quota(fraction: float) -> Quota:
    """round-half-even of ``fraction`` of each class."""
    return lambda counts: counts.select(
        "*", F.bround(F.col("n") * F.lit(fraction), 0).cast("long").alias("target")
    )


def _over(run: Sequence[str]):
    return Window.partitionBy(*run) if run else Window.partitionBy(F.lit(0))


def apportioned_quota(total: Callable[[Column], Column], label: str, run=()) -> Quota:
    """Split ``total(n_all)`` rows over the classes by largest remainder."""

    def quota(counts: DataFrame) -> DataFrame:
        per_run = _over(run)
        sized = counts.withColumn("_all", F.sum("n").over(per_run))
        sized = sized.withColumn("_total", total(F.col("_all")).cast("long"))
        wide = "cast(n as decimal(19, 0)) * cast(_total as decimal(19, 0))"  # too large for a long
        shared = sized.withColumn("_base", F.expr(f"{wide} div cast(_all as decimal(19, 0))")).withColumn(
            "_rest", F.expr(f"cast({wide} % cast(_all as decimal(19, 0)) as long)")
        )
        spare = F.col("_total") - F.sum("_base").over(per_run)
        order = F.row_number().over(per_run.orderBy(F.desc("_rest"), label))
        return (
            shared.withColumn("_spare", spare)
            .withColumn("_order", order)
            .withColumn(
                "target", F.col("_base") + (F.col("_order") <= F.col("_spare")).cast("long")
            )
            .drop("_all", "_total", "_base", "_rest", "_spare", "_order")
        )

    return quota


def prevalence_quota(size: int, label: str, run=()) -> Quota:
    """``round(size * share)`` per class; the whole round-off goes to the largest class."""

    def quota(counts: DataFrame) -> DataFrame:
        per_run = _over(run)
        shared = counts.withColumn("_all", F.sum("n").over(per_run)).withColumn(
            "_raw", F.bround(F.lit(size) * F.col("n") / F.col("_all"), 0).cast("long")
        )
        largest = F.row_number().over(per_run.orderBy(F.desc("n"), label)) == 1
        spill = F.lit(size) - F.sum("_raw").over(per_run)
        return (
            shared.withColumn("_spill", spill)
            .withColumn("_largest", largest)
            .withColumn(
                "target",
                F.least(
                    F.col("n"),
                    F.col("_raw") + F.when(F.col("_largest"), F.col("_spill")).otherwise(0),
                ),
            )
            .drop("_all", "_raw", "_largest", "_spill")
        )

    return quota


def balanced_quota(size: int, run=()) -> Quota:
    """``size`` divided evenly over the classes (whole rows)."""

    def quota(counts: DataFrame) -> DataFrame:
        classes = F.count(F.lit(1)).over(_over(run))
        return counts.withColumn("_classes", classes).select(
            *counts.columns, F.expr(f"{int(size)} div _classes").alias("target")
        )

    return quota


# --- samples and splits -----------------------------------------------------------------


def per_class(
    df: DataFrame, label: str, k: int, keys: Sequence[str], seeds: Sequence[int] = (42,)
) -> DataFrame:
    """k rows of each class for each seed (all rows of a smaller class)."""
    return take_lowest(with_seeds(df, seeds, keys), ["seed", label], fixed_quota(k))


def shot_and_test(
    df: DataFrame,
    label: str,
    shots: int,
    tests: int,
    keys: Sequence[str],
    seeds: Sequence[int] = (42,),
) -> DataFrame:
    """Disjoint few-shot and test rows per class; small classes fill the shots first."""
    drawn = with_seeds(df, seeds, keys)
    strata = ["seed", label]
    if 0 <= shots and 0 <= tests and shots + tests <= FEW:
        both = few_lowest(drawn, strata, shots + tests)
        part = F.when(F.col("_place") <= shots, "shot").otherwise("test")
        return both.withColumn("part", part).drop("_place")
    flagged = mark_lowest(drawn, strata, fixed_quota(shots), out="_shot")
    both = mark_lowest(flagged, strata, fixed_quota(shots + tests)).where("taken")
    return both.withColumn("part", F.when(F.col("_shot"), "shot").otherwise("test")).drop("_shot", "taken")


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    test_size: float = 0.3,
    seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """Add ``part``; shares per class by largest remainder.

    Without stratification, or if a class has fewer than two rows, one draw over all rows.
    """
    drawn = with_draw(df, keys, seed)
    train_rows = lambda n: n - F.ceil(n * F.lit(test_size))
    if stratify:
        smallest = class_counts(drawn, [label]).agg(F.min("n")).first()[0]
        stratify = smallest is not None and smallest >= 2
    if stratify:
        flagged = mark_lowest(drawn, [label], apportioned_quota(train_rows, label))
    else:
        flagged = mark_lowest(
            drawn, [], lambda counts: counts.withColumn("target", train_rows(F.col("n")))
        )
    return flagged.withColumn("part", F.when(F.col("taken"), "train").otherwise("test")).drop("taken")


def pool_and_holdout(
    df: DataFrame, label: str, keys: Sequence[str], holdout: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: half-even rounded share of each class held out."""
    flagged = mark_lowest(with_draw(df, keys, seed), [label], share_quota(holdout))
    return flagged.withColumn("part", F.when(F.col("taken"), "holdout").otherwise("pool")).drop("taken")


def chronological_split(
    df: DataFrame,
    label: str,
    order_col: str,
    keys: Sequence[str],
    shots: int,
    tests: int | None = None,
    train_frac: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """Few-shot rows from the early part of each class, test rows from its late part.

    ``order_col`` is a long that rises with time and is unique. ``part`` is ``shot`` or
    ``test``; ``tests`` keeps only the earliest late rows of a class. A class without an
    early or a late part is left out.
    """
    counts = class_counts(df, [label])

    def early(counted: DataFrame) -> DataFrame:
        cut = F.greatest(F.lit(shots), F.bround(F.col("n") * F.lit(train_frac), 0).cast("long"))
        cut = F.when(F.col("n") > 1, F.least(cut, F.col("n") - 1)).otherwise(cut)
        return counted.withColumn("target", F.greatest(cut, F.lit(0)).cast("long"))

    usable = early(counts).where((F.col("target") > 0) & (F.col("target") < F.col("n")))
    kept = join_strata(df, _held(usable.select(label)), [label])
    timed = kept.withColumn("_when", F.col(order_col).cast("long")).withColumn("_no_tie", F.lit(""))
    flagged = mark_lowest(timed, [label], early, key="_when", tie="_no_tie", out="_early")
    late = flagged.where(~F.col("_early"))
    if tests is not None:
        late = take_lowest(late, [label], fixed_quota(tests), key="_when", tie="_no_tie")
    shot = with_draw(flagged.where("_early"), keys, seed)
    shot = take_lowest(shot, [label], fixed_quota(shots))
    shot = shot.drop("draw", "digest").withColumn("part", F.lit("shot"))
    return shot.unionByName(late.withColumn("part", F.lit("test"))).drop(
        "_when", "_no_tie", "_early"
    )


def cap_per_class(
    df: DataFrame, label: str, cap: int, keys: Sequence[str] = (), seed: int = 42,
    order_col: str | None = None,
) -> DataFrame:
    """At most ``cap`` rows per class: random by key, or the earliest by ``order_col``."""
    if order_col is None:
        drawn = with_draw(df, keys, seed)
        return take_lowest(drawn, [label], fixed_quota(cap)).drop("draw", "digest")
    timed = df.withColumn("_when", F.col(order_col).cast("long")).withColumn("_no_tie", F.lit(""))
    return take_lowest(timed, [label], fixed_quota(cap), key="_when", tie="_no_tie").drop(
        "_when", "_no_tie"
    )


def prevalence_sample(
    df: DataFrame, label: str, size: int, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    return take_lowest(with_draw(df, keys, seed), [label], prevalence_quota(size, label))


def balanced_sample(
    df: DataFrame, label: str, size: int, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    return take_lowest(with_draw(df, keys, seed), [label], balanced_quota(size))


def proportional_sample(
    df: DataFrame, label: str, size: int, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """Share of each class but at least one row, trimmed by draw to ``size`` rows."""

    def quota(counts: DataFrame) -> DataFrame:
        whole = F.sum("n").over(_over(()))
        share = F.bround(F.lit(size) * F.col("n") / F.col("_all"), 0).cast("long")
        return counts.withColumn("_all", whole).select(
            *counts.columns, F.least("n", F.greatest(F.lit(1), share)).alias("target")
        )

    chosen = take_lowest(with_draw(df, keys, seed), [label], quota)
    return take_lowest(chosen, [], fixed_quota(size))


def uniform_sample(df: DataFrame, size: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``size`` rows without replacement."""
    return take_lowest(with_draw(df, keys, seed), [], fixed_quota(size))


def budget_samples(
    df: DataFrame,
    label: str,
    budgets: DataFrame,
    keys: Sequence[str],
    seeds: Sequence[int] = (42,),
) -> DataFrame:
    """Training rows for each model: ``budgets`` is (model, budget), null budget = all rows.

    All models and seeds share one draw, so a smaller budget is nested in a larger one.
    """
    rows = collect_bounded(budgets.select("model", "budget"), MAX_STRATA)
    if rows is None:
        raise ValueError(f"more than {MAX_STRATA} models")
    named = local_table(df.sparkSession, rows, budgets.select("model", "budget").schema)
    models = F.array(*[F.lit(r["model"]) for r in rows])
    drawn = with_seeds(df, seeds, keys).withColumn("model", F.explode(models))

    def quota(counts: DataFrame) -> DataFrame:
        run = Window.partitionBy("seed", "model")
        sized = counts.join(named, "model").withColumn("_all", F.sum("n").over(run))
        limit = F.least(F.coalesce("budget", "_all"), F.col("_all"))
        sized = sized.withColumn("_limit", limit)
        sized = sized.withColumn(
            "_raw", F.bround(F.col("_limit") * F.col("n") / F.col("_all"), 0).cast("long")
        )
        first = F.row_number().over(run.orderBy(F.desc("n"), label)) == 1
        spill = F.col("_limit") - F.sum("_raw").over(run)
        return sized.withColumn("_first", first).withColumn("_spill", spill).select(
            *counts.columns,
            F.least(
                F.col("n"), F.col("_raw") + F.when(F.col("_first"), F.col("_spill")).otherwise(0)
            ).alias("target"),
        )

    return take_lowest(drawn, ["seed", "model", label], quota)


def leave_one_class_out(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    normal_label: str = "Normal",
    max_normal: int = 4000,
    max_unseen: int = 2000,
    seed: int = 42,
    disjoint: bool = True,
) -> DataFrame:
    """For each attack class h: ``train`` = all other rows, ``test`` = Normal and h rows.

    ``target`` is the binary label. With ``disjoint`` the test Normals leave training.
    """
    found = collect_bounded(
        df.where(F.col(label) != normal_label).select(label).distinct(), MAX_STRATA
    )
    if found is None:
        raise ValueError(f"more than {MAX_STRATA} classes")
    classes = sorted(r[0] for r in found)
    drawn = with_draw(df, keys, seed)
    candidates = drawn.withColumn("_is_normal", F.col(label) == normal_label)

    def quota(counts: DataFrame) -> DataFrame:
        size = F.when(F.col(label) == normal_label, max_normal).otherwise(max_unseen)
        return counts.withColumn("target", size.cast("long"))

    # The capped test rows of a class do not depend on which class is held out.
    flagged = mark_lowest(candidates, [label], quota, out="_test")
    fanned = flagged.withColumn("heldout", F.explode(F.array(*[F.lit(c) for c in classes])))
    unseen = F.col(label) == F.col("heldout")
    test = F.col("_test") & (F.col("_is_normal") | unseen)
    if disjoint:
        train = ~unseen & ~(F.col("_is_normal") & F.col("_test"))
    else:
        train = ~unseen
    parts = F.array_compact(
        F.array(F.when(train, F.lit("train")), F.when(test, F.lit("test")))
    )
    return (
        fanned.withColumn("part", F.explode(parts))
        .withColumn("target", F.when(F.col("_is_normal"), normal_label).otherwise("Attack"))
        .drop("_is_normal", "_test", "draw", "digest")
    )


# --- class weights ----------------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * n)."""
    counts = class_counts(df, [label])
    whole = Window.partitionBy(F.lit(0))
    return counts.select(
        label,
        "n",
        (
            F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
        ).alias("weight"),
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    rows = collect_bounded(class_weights(df, label), MAX_STRATA)
    if rows is None:
        return df.join(class_weights(df, label).select(label, F.col("weight").alias(out)), label)
    spark = df.sparkSession
    table = local_table(spark, [(r[0], r[2]) for r in rows], df.select(label).schema.add(out, "double"))
    return df.join(table, label)


def positive_weight(df: DataFrame, label: str, run=(), normal_label: str = "Normal") -> DataFrame:
    """negatives / max(1, positives)."""
    positive = F.sum((F.col(label) != normal_label).cast("long"))
    negative = F.sum((F.col(label) == normal_label).cast("long"))
    return df.groupBy(*run).agg(
        (negative / F.greatest(F.lit(1), positive)).alias("pos_weight")
    )
