"""Column and row cleaning.

Which columns go is itself a query: one aggregate profiles every column, then a single
projection applies the decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column names of the public data sets ---
SWAT_LABEL_NAMES = ["Normal/Attack", "Normal_Attack", "label", "Label", "Attack"]
HAI_LABEL_NAMES = ["Attack", "attack", "label", "Label"]
WUSTL_LABEL_NAMES = ["type", "Traffic", "Target", "label", "Label"]
TIME_NAMES = ["timestamp", "time", "datetime", "date", "unnamed: 0"]
LEAKAGE_NAMES = ["StartTime", "LastTime", "SrcAddr", "DstAddr", "sIpId", "dIpId"]
# --- end of fixed values ---

FLOAT_MAX = 3.4028234663852886e38
INT_MAX = 2**31 - 1


# --- schema-only steps -------------------------------------------------------------------


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def find_label(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """First candidate present, ignoring case and outer spaces."""
    present = {}
    for name in columns:
        present.setdefault(name.strip().lower(), name)
    for candidate in candidates:
        if candidate.strip().lower() in present:
            return present[candidate.strip().lower()]
    raise KeyError(f"no label column among {list(columns)}")


def rename_label(df: DataFrame, candidates: Sequence[str], to: str = "label") -> DataFrame:
    return df.withColumnRenamed(find_label(df.columns, candidates), to)


def drop_non_features(
    df: DataFrame,
    label: str = "label",
    names: Sequence[str] = tuple(TIME_NAMES),
    any_time: bool = False,
) -> DataFrame:
    """Drop ``names``, names with a leading underscore and, optionally, any "time" name."""
    exact = {n.lower() for n in names}

    def unwanted(column: str) -> bool:
        low = column.strip().lower()
        return low in exact or low.startswith("_") or (any_time and "time" in low)

    return df.drop(*[c for c in df.columns if c != label and unwanted(c)])


def drop_leakage(df: DataFrame, names: Sequence[str] = tuple(LEAKAGE_NAMES)) -> DataFrame:
    return df.drop(*names)


# --- values ------------------------------------------------------------------------------


def number(column: Column) -> Column:
    """Number or null: bad text, NaN and infinities are null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in features})


def drop_incomplete(df: DataFrame, features: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(features))


def profile_columns(df: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    """Rows, nulls, minimum and maximum of every feature, from one aggregate."""
    wanted = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(features):
        column = F.col(f"`{name}`")
        wanted += [
            F.count(column).alias(f"_known{i}"),
            F.min(column).alias(f"_min{i}"),
            F.max(column).alias(f"_max{i}"),
        ]
    row = df.agg(*wanted).first()
    return {
        name: {
            "rows": row["_rows"],
            "nulls": row["_rows"] - row[f"_known{i}"],
            "min": row[f"_min{i}"],
            "max": row[f"_max{i}"],
        }
        for i, name in enumerate(features)
    }


def drop_sparse(df: DataFrame, features: Sequence[str], max_null: float = 0.5) -> DataFrame:
    found = profile_columns(df, features)
    return df.drop(*[c for c, p in found.items() if p["rows"] and p["nulls"] > max_null * p["rows"]])


def drop_constant(df: DataFrame, features: Sequence[str]) -> DataFrame:
    found = profile_columns(df, features)
    return df.drop(*[c for c, p in found.items() if p["min"] == p["max"]])


def drop_repeats(df: DataFrame, columns: Sequence[str], order_col: str | None = None) -> DataFrame:
    """One row per value combination; with ``order_col`` the first one."""
    if order_col is None:
        return df.dropDuplicates(list(columns))
    rest = [c for c in df.columns if c not in columns and c != order_col]
    if not rest:
        return df.groupBy(*columns).agg(F.min(order_col).alias(order_col)).select(*df.columns)
    first = F.min(F.struct(order_col, *rest)).alias("_first")
    return df.groupBy(*columns).agg(first).select(
        *[F.col(c) if c in columns else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


# --- medians -----------------------------------------------------------------------------

_ACCURACY = 10_000
#: values kept for the exact rank step, per feature
BRACKET_ROWS = 1_000_000


def exact_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Interpolated medians without sorting a column in one task.

    Each pass brackets the middle ranks between two approximate quantiles; once few
    enough values are left between the brackets they are counted and ranked.
    """
    features = list(features)
    row = df.agg(
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(features)],
        *[F.min(f"`{c}`").cast("double").alias(f"lo{i}") for i, c in enumerate(features)],
        *[F.max(f"`{c}`").cast("double").alias(f"hi{i}") for i, c in enumerate(features)],
    ).first()
    medians: dict[str, float | None] = {}
    state = {}
    for i, name in enumerate(features):
        if row[f"n{i}"] == 0:
            medians[name] = None
        else:
            ranks = ((row[f"n{i}"] - 1) // 2, row[f"n{i}"] // 2)
            state[name] = (row[f"lo{i}"], row[f"hi{i}"], 0, row[f"n{i}"], ranks)
    while wide := {c: s for c, s in state.items() if s[3] > BRACKET_ROWS and s[0] < s[1]}:
        state.update(_narrow_brackets(df, wide))
    if not state:
        return medians
    pieces = F.array(
        *[
            F.struct(
                F.lit(c).alias("_feature"),
                F.when(
                    F.col(f"`{c}`").between(lo, hi), F.col(f"`{c}`").cast("double")
                ).alias("_value"),
            )
            for c, (lo, hi, *_) in state.items()
        ]
    )
    values = (
        df.select(F.inline(pieces))
        .where(F.col("_value").isNotNull())
        .groupBy("_feature", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = (
        Window.partitionBy("_feature")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hit = F.lit(False)
    cumulative = values.withColumn("_cum", F.sum("_n").over(upto))
    for c, (_, _, below, _, ranks) in state.items():
        for rank in ranks:
            place = rank - below
            hit = hit | (
                (F.col("_feature") == c)
                & (F.col("_cum") > place)
                & (F.col("_cum") - F.col("_n") <= place)
            )
    found: dict[str, list[float]] = {}
    for r in cumulative.where(hit).select("_feature", "_value").collect():
        found.setdefault(r[0], []).append(r[1])
    for c, values_found in found.items():
        medians[c] = (min(values_found) + max(values_found)) / 2
    return medians


def _narrow_brackets(df: DataFrame, state: dict) -> dict:
    names = list(state)
    quantiles = []
    for i, c in enumerate(names):
        lo, hi, below, inside, ranks = state[c]
        margin = 2.0 / _ACCURACY
        low = max(0.0, (ranks[0] - below) / inside - margin)
        high = min(1.0, (ranks[1] - below + 1) / inside + margin)
        held = F.when(F.col(f"`{c}`").between(lo, hi), F.col(f"`{c}`").cast("double"))
        quantiles.append(F.percentile_approx(held, [low, high], _ACCURACY).alias(f"q{i}"))
    edges = df.agg(*quantiles).first()
    counts = []
    for i, c in enumerate(names):
        lo, hi = edges[i]
        column = F.col(f"`{c}`").cast("double")
        counts += [
            F.sum((column < lo).cast("long")).alias(f"b{i}"),
            F.sum(column.between(lo, hi).cast("long")).alias(f"k{i}"),
        ]
    row = df.agg(*counts).first()
    result = {}
    for i, c in enumerate(names):
        lo, hi = edges[i]
        # A bracket that stops shrinking holds few distinct values; ranking it is cheap.
        stuck = row[f"k{i}"] >= state[c][3]
        inside = BRACKET_ROWS if stuck else row[f"k{i}"]
        result[c] = (lo, hi, row[f"b{i}"], inside, state[c][4])
    return result


def impute_medians(df: DataFrame, features: Sequence[str], exact: bool = True) -> DataFrame:
    """Missing values become the column median, or 0 in an all-null column."""
    if exact:
        medians = exact_medians(df, features)
    else:
        row = df.agg(
            *[F.percentile_approx(f"`{c}`", 0.5, _ACCURACY).alias(f"m{i}") for i, c in enumerate(features)]
        ).first()
        medians = {c: row[i] for i, c in enumerate(features)}
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c]), F.lit(0.0)) for c in features}
    )


def narrow_types(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """double → float and bigint → int where every value is inside the narrower range."""
    wide = [c for c in features if isinstance(df.schema[c].dataType, (T.DoubleType, T.LongType))]
    found = profile_columns(df, wide)
    casts = {}
    for c in wide:
        is_double = isinstance(df.schema[c].dataType, T.DoubleType)
        limit = FLOAT_MAX if is_double else INT_MAX
        low, high = found[c]["min"], found[c]["max"]
        if low is not None and -limit < low and high < limit:
            casts[c] = F.col(c).cast("float" if is_double else "int")
    return df.withColumns(casts) if casts else df


# --- feature groups ------------------------------------------------------------------------

# --- fixed values: naming rules, first match wins ---
SWAT_GROUPS = [
    ("LIT", "(?i)^LIT"),
    ("FIT", "(?i)^FIT"),
    ("AIT", "(?i)^AIT"),
    ("DPIT", "(?i)^DPIT"),
    ("PIT", "(?i)^PIT"),
    ("MV", "(?i)^MV"),
    ("P", "(?i)^P(?!I)"),
    ("UV", "(?i)^UV"),
]
HAI_GROUPS = [("P1", "^P1"), ("P2", "^P2"), ("P3", "^P3"), ("P4", "^P4"), ("Other", ".*")]
WUSTL_GROUPS = [
    ("Volume", "(?i)^(?!.*rate).*(pkt|byte|load)"),
    ("Timing", "(?i)(rate|dur|time|gap|intpkt)"),
    ("TCP layer", "(?i)(ttl|win|ack|seq|tcp)"),
    ("Port/Proto", "(?i)(sport|dport|proto|state|dir)"),
    ("Loss", "(?i)(loss|retr|drop)"),
    ("Other", ".*"),
]
# --- end of fixed values ---


def group_of(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    result = F.when(name.rlike(rules[0][1]), rules[0][0])
    for group, pattern in rules[1:]:
        result = result.when(name.rlike(pattern), group)
    return result


def feature_groups(names: DataFrame, rules: Sequence[tuple[str, str]], column: str = "feature") -> DataFrame:
    """(feature, group); features that match no rule are left out."""
    return names.withColumn("group", group_of(F.col(column), rules)).where(F.col("group").isNotNull())


# --- label column detection ------------------------------------------------------------------


def _label_facts(df: DataFrame, candidates: Sequence[str]) -> dict[str, dict]:
    present = [c for c in candidates if c in df.columns]
    if not present:
        return {}
    aggregates = []
    for i, c in enumerate(present):
        text = F.lower(F.trim(F.col(f"`{c}`").cast("string")))
        value = number(text).try_cast("long")
        aggregates += [
            F.count(f"`{c}`").alias(f"n{i}"),
            F.count(value).alias(f"num{i}"),
            F.sum(value.isin(0, 1).cast("long")).alias(f"bit{i}"),
            F.sum(text.isin("normal", "attack").cast("long")).alias(f"word{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
    row = df.agg(*aggregates).first().asDict()
    facts = {
        c: {k: row[f"{k}{i}"] or 0 for k in ("n", "num", "bit", "word", "lo", "hi")}
        for i, c in enumerate(present)
    }
    between = df.agg(
        *[
            F.max(
                ~number(F.trim(F.col(f"`{c}`").cast("string")))
                .try_cast("long")
                .isin(facts[c]["lo"], facts[c]["hi"])
            ).alias(f"m{i}")
            for i, c in enumerate(present)
        ]
    ).first()
    for i, c in enumerate(present):
        facts[c]["many"] = bool(between[i])
    return facts


def find_binary_label(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is 0/1 (99 % numeric at least) or the words normal/attack."""
    for name, fact in _label_facts(df, candidates).items():
        if fact["n"] == 0:
            continue
        bits = fact["num"] >= 0.99 * fact["n"] and fact["bit"] == fact["num"]
        if bits or fact["word"] == fact["n"]:
            return name
    return None


def find_categorical_label(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is mostly text, or has more than two whole numbers."""
    for name, fact in _label_facts(df, candidates).items():
        if fact["n"] and (fact["num"] < 0.5 * fact["n"] or fact["many"]):
            return name
    return None


def keep_classes(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    return df.where(F.col(label).isin(list(classes)))


def require_two_classes(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself; an error when fewer than two labels are left."""
    row = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if row["low"] is None or row["low"] == row["high"]:
        raise ValueError(f"column {label} holds a single class: {row['low']!r}")
    return df
