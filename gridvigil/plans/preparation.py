"""The fixed preparation order: constant columns, repeats, gaps, windows, scaling, PCA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridvigil.operators import cleaning, features, timeseries
from gridvigil.sources.datasets import DatasetConfig


def prepare(
    df: DataFrame,
    config: DatasetConfig,
    label: str = "label",
    order_cols: Sequence[str] = (),
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Features and label ready for a classifier.

    ``order_cols`` (a unique order within ``group_cols``) is needed for windows only.
    """
    keys = [*order_cols, *group_cols]
    names = lambda frame: [c for c in frame.columns if c != label and c not in keys]
    if config.drop_constant:
        df = cleaning.drop_constant(df, names(df))
    if config.remove_duplicates:
        first = order_cols[0] if order_cols else None
        df = cleaning.drop_repeats(df, [*names(df), label], first)
    df = cleaning.impute_medians(df, names(df))
    if config.window_size > 1:
        if not order_cols:
            raise ValueError("windows need order_cols")
        df = timeseries.sliding_windows(
            df,
            names(df),
            label,
            order_cols,
            config.window_size,
            config.window_stride,
            config.window_agg,
            group_cols,
        )
        keys = [*group_cols, "window_id"]
    if config.normalize:
        df = features.standardise(df, names(df))
    if config.pca:
        if not config.normalize:
            raise ValueError("components need normalised features")
        parts = features.fit_components(df, names(df), config.pca_components)
        df = parts.transform(df)
    return df
