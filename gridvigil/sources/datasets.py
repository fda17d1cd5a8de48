"""Loaders for the three public industrial data sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridvigil.functions import labels
from gridvigil.operators import cleaning
from gridvigil.sources.files import find_files, read_delimited


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    binary: bool = True
    window_size: int = 1
    window_stride: int = 1
    window_agg: str = "stats"
    normalize: bool = True
    pca: bool = False
    pca_components: int = 25
    drop_constant: bool = True
    remove_duplicates: bool = True
    max_null: float = 0.5
    groups: Sequence[tuple[str, str]] = field(default=())


# --- fixed values: defaults of the three data sets ---
SWAT = DatasetConfig("swat", groups=tuple(cleaning.SWAT_GROUPS))
HAI = DatasetConfig(
    "hai", pca_components=30, remove_duplicates=False, groups=tuple(cleaning.HAI_GROUPS)
)
WUSTL = DatasetConfig(
    "wustl", binary=False, pca_components=20, groups=tuple(cleaning.WUSTL_GROUPS)
)
HAI_VERSIONS = ["hai-22.04", "hai-21.03", "hai-20.07", "hai-1.0", "hai-2.0", "hai-3.0"]
# --- end of fixed values ---


def clean_swat(raw: DataFrame, config: DatasetConfig = SWAT) -> DataFrame:
    """Numeric sensors and a cleaned ``label``; rows with any missing sensor are dropped."""
    df = cleaning.rename_label(cleaning.strip_headers(raw), cleaning.SWAT_LABEL_NAMES)
    df = cleaning.drop_non_features(df)
    df = df.withColumn("label", labels.letters_only(F.col("label"), config.binary))
    return _numeric(df, config, "any")


def clean_hai(raw: DataFrame, config: DatasetConfig = HAI) -> DataFrame:
    """The plain attack column, else any per-process indicator; indicators never stay features."""
    df = cleaning.strip_headers(raw)
    parts = [c for c in df.columns if c.lower().startswith("attack_p")]
    try:
        df = cleaning.rename_label(df, cleaning.HAI_LABEL_NAMES)
        value = labels.truthy_label(F.col("label")) if config.binary else F.trim(F.col("label"))
        df = df.withColumn("label", value)
    except KeyError:
        parts = parts or [c for c in df.columns if "attack" in c.lower()]
        if not parts:
            raise
        df = df.withColumn("label", labels.any_indicator(parts))
    df = cleaning.drop_non_features(df.drop(*parts), any_time=True)
    return _numeric(df, config, "all")


# --- fixed values: label columns of flow tables, in order of preference ---
WUSTL_BIT_LABELS = ("Target", "target", "Label", "label", "Traffic", "traffic", "type")
WUSTL_KIND_LABELS = ("Traffic", "traffic", "Attack", "Category", "attack_cat", "type")
# --- end of fixed values ---


def clean_wustl(raw: DataFrame, config: DatasetConfig = WUSTL) -> DataFrame:
    """Flow features without leakage columns; binary or five-class ``label``."""
    df = cleaning.drop_leakage(cleaning.strip_headers(raw))
    bits = [c for c in WUSTL_BIT_LABELS if c in df.columns]
    kinds = [c for c in WUSTL_KIND_LABELS if c in df.columns]
    binary = cleaning.find_binary_label(df, bits)
    kind = cleaning.find_categorical_label(df, kinds)
    if config.binary and binary is not None:
        value = labels.truthy_label(F.col(f"`{binary}`"))
    elif kind is not None:
        value = labels.five_class(F.col(f"`{kind}`"))
        value = labels.collapsed(value) if config.binary else value
    elif binary is not None:  # no attack names: the two classes are all there is
        value = labels.truthy_label(F.col(f"`{binary}`"))
    else:
        raise KeyError(f"no label column among {df.columns}")
    # every label candidate goes, or one would tell the label as a feature
    df = df.withColumn("_label", value).drop(*{*bits, *kinds})
    df = cleaning.drop_non_features(df.withColumnRenamed("_label", "label"))
    return _numeric(df, config, "all")


def _numeric(df: DataFrame, config: DatasetConfig, how: str) -> DataFrame:
    features = [c for c in df.columns if c != "label"]
    numbers = cleaning.to_numbers(df, features)
    kept = cleaning.drop_sparse(numbers, features, config.max_null)
    features = [c for c in kept.columns if c != "label"]
    return cleaning.drop_incomplete(kept, features, how)


CLEANERS = {"swat": (clean_swat, SWAT), "hai": (clean_hai, HAI), "wustl": (clean_wustl, WUSTL)}


def load(
    spark: SparkSession, name: str, folder: str, config: DatasetConfig | None = None
) -> DataFrame:
    """Read and clean one of the data sets from its folder of CSV files."""
    clean, default = CLEANERS[name]
    preferred = HAI_VERSIONS if name == "hai" else ()
    raw = read_delimited(spark, find_files(spark, folder, preferred=preferred))
    return clean(raw, config or default)
