"""Rows to text, and answers back to labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)
_WHOLES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def raw_json(features: Sequence[str]) -> Column:
    """Compact JSON object of the features, missing values as null."""
    return F.to_json(F.struct(*features), {"ignoreNullFields": "false"})


def typed_json(df: DataFrame, features: Sequence[str], places: int = 4) -> Column:
    """Compact JSON with floats rounded and anything that is no number as text."""

    def cell(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, _FLOATS):
            return F.round(F.col(name).cast("double"), places).alias(name)
        if isinstance(kind, _WHOLES):
            return F.col(name)
        return F.col(name).cast("string").alias(name)

    return F.to_json(F.struct(*[cell(c) for c in features]), {"ignoreNullFields": "false"})


def four_figures(values: Column) -> Column:
    """C-style ``%.4g`` text of every number in an array column.

    Each ``transform`` names intermediate results, so nothing is computed twice and the
    expression stays small for any number of features. A tie that only comes from
    rounding the scaled value is settled by the exact rounding error (two-product).
    """
    split = F.lit(134217729.0)  # 2^27 + 1 halves the bits of a double

    def upper_half(x: Column) -> Column:
        return split * x - (split * x - x)

    def size(v: Column) -> Column:
        x = F.abs(v)
        return F.struct(v.alias("v"), x.alias("x"), F.floor(F.log10(x)).cast("int").alias("e"))

    def scale(s: Column) -> Column:
        power = F.pow(F.lit(10.0), F.abs(3 - s["e"]))
        return F.struct(s["v"].alias("v"), s["x"].alias("x"), s["e"].alias("e"), power.alias("c"))

    def scaled(s: Column) -> Column:
        big = s["e"] > 3
        q = F.when(big, s["x"] / s["c"]).otherwise(s["x"] * s["c"])
        # a · c is the product whose rounding error decides a tie
        a = F.when(big, s["x"] / s["c"]).otherwise(s["x"])
        return F.struct(
            s["v"].alias("v"), s["x"].alias("x"), s["e"].alias("e"), s["c"].alias("c"),
            q.alias("q"), a.alias("a"),
        )

    def rounded(s: Column) -> Column:
        a, c, q = s["a"], s["c"], s["q"]
        whole = F.floor(q)

        def rest() -> Column:
            ah, ch = upper_half(a), upper_half(c)
            al, cl = a - ah, c - ch
            error = (ah * ch - a * c) + ah * cl + al * ch + al * cl
            return F.when(s["e"] > 3, (s["x"] - a * c) - error).otherwise(error)

        tie = q - whole == 0.5
        figures = (
            F.when(~tie, F.bround(q, 0).cast("long"))
            .when(rest() > 0, whole + 1)
            .when(rest() < 0, whole)
            .otherwise(F.bround(q, 0).cast("long"))
        )
        return F.struct(s["v"].alias("v"), s["e"].alias("e"), figures.alias("m"))

    def carried(s: Column) -> Column:
        over = s["m"] >= 10_000
        return F.struct(
            s["v"].alias("v"),
            (s["e"] + over.cast("int")).alias("p"),
            F.when(over, "1000").otherwise(s["m"].cast("string")).alias("d"),
        )

    def shown(s: Column) -> Column:
        power, digits = s["p"], s["d"]
        near = power.between(-4, 3)
        # the point sits after this many leading characters
        padded = F.when(
            near & (power < 0), F.concat(F.repeat(F.lit("0"), -power), digits)
        ).otherwise(digits)
        before = F.when(near & (power >= 0), power + 1).otherwise(F.lit(1))
        body = F.concat(
            F.substring(padded, F.lit(1), before), F.lit("."), F.substring(padded, before + 1, F.lit(8))
        )
        # zeros after the point go, and the point with them
        trimmed = F.rtrim(F.rtrim(body, F.lit("0")), F.lit("."))
        tail = F.when(near, "").otherwise(
            F.concat(
                F.when(power < 0, "e-").otherwise("e+"),
                F.lpad(F.abs(power).cast("string"), 2, "0"),
            )
        )
        sign = F.when(s["v"] < 0, "-").otherwise("")
        return F.when(s["v"] == 0, "0").otherwise(F.concat(sign, trimmed, tail))

    result = values.cast("array<double>")
    for stage in (size, scale, scaled, rounded, carried, shown):
        result = F.transform(result, stage)
    return result


def with_narrative(df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Add ``name = value; name = value`` with four significant figures."""
    floats = [c for c in features if isinstance(df.schema[c].dataType, _FLOATS)]
    shown = df
    if floats:
        values = F.array(*[F.col(c).cast("double") for c in floats])
        shown = df.withColumn("_shown", four_figures(values))

    def cell(name: str) -> Column:
        if name in floats:
            text = F.col("_shown")[floats.index(name)]
        else:
            text = F.col(name).cast("string")
        return F.concat(F.lit(f"{name} = "), F.coalesce(text, F.lit("nan")))

    text = F.concat_ws("; ", *[cell(c) for c in features])
    return shown.withColumn(out, text).drop("_shown")


def with_row_text(df: DataFrame, features: Sequence[str], form: str, out: str) -> DataFrame:
    """Add the row's text in one of the four prompt forms."""
    if form in ("raw-json", "role-instructed-ot"):
        return df.withColumn(out, raw_json(features))
    if form == "typed-json":
        return df.withColumn(out, typed_json(df, features))
    if form == "nl-narrative":
        return with_narrative(df, features, out)
    raise ValueError(f"unknown row format {form}")


# --- answers -----------------------------------------------------------------------------

_WORD = "[A-Za-z0-9_]"


def last_label(text: Column, labels: Sequence[str]) -> Column:
    """Label whose last whole-word hit starts latest, any case; null without a hit."""
    trimmed = F.trim(text)
    hits = []
    for label in labels:
        # Greedy prefix: group 1 ends where the last hit starts.
        pattern = f"(?is)^(.*)(?<!{_WORD}){re.escape(label)}(?!{_WORD})"
        found = F.length(F.regexp_extract(trimmed, pattern, 0)) > 0
        start = F.length(F.regexp_extract(trimmed, pattern, 1))
        hits.append(
            F.when(
                found,
                F.struct(
                    start.alias("start"), F.lit(len(label)).alias("size"), F.lit(label).alias("label")
                ),
            )
        )
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return best["label"]


def first_label(text: Column, labels: Sequence[str]) -> Column:
    """Longest label found as a whole word, else the first found anywhere, any case."""
    trimmed = F.trim(text)
    result = None
    for label in sorted(labels, key=len, reverse=True):
        hit = trimmed.rlike(rf"(?i)\b{re.escape(label)}\b")
        result = F.when(hit, label) if result is None else result.when(hit, label)
    for label in labels:
        result = result.when(F.contains(F.lower(trimmed), F.lit(label.lower())), label)
    return result
