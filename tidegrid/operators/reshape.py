"""Sorting, top-k, set and shape operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, by: list[str], order: list[Column], k: int, spread: list[str]) -> DataFrame:
    """The first k rows of each group in `order`. Rows are first cut to k per
    group and slice (a hash of the `spread` columns), so a group with most of
    the rows is ranked in slices and only their winners meet."""
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*spread), F.lit(256)))
    first = Window.partitionBy(*by, "__slice").orderBy(*order)
    part = sliced.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= k)
    last = Window.partitionBy(*by).orderBy(*order)
    return part.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).drop("__slice", "__rn")


def in_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Rows sorted by an explicit list of categories; others after, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return df.withColumn("ordinal", F.when(place > 0, place)).orderBy(F.col("ordinal").asc_nulls_last(), col)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by the order columns."""
    rest = [c for c in df.columns if c not in keys]
    d = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return d.select(*keys, "__r.*").select(*df.columns)


def complete_cells(parts: DataFrame, row: str, col: str, value: str, categories: list[str]) -> DataFrame:
    """Every category of the list (an atlas's regions) against every
    recording, missing cells kept as null."""
    cells = parts.select(col).distinct().withColumn(row, F.explode(F.array(*[F.lit(c) for c in categories])))
    return cells.join(parts.select(row, col, value), [row, col], "left")


def pivot_long(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def melt(df: DataFrame, keys: list[str], cols: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def remap_ids(df: DataFrame, mapping: DataFrame, id_: str, old: str, new: str) -> DataFrame:
    """Replace ids found in the mapping. An old id listed twice is an error."""
    from tidegrid.operators.joins import assert_unique

    m = assert_unique(mapping.select(F.col(old).alias(id_), F.col(new).alias("__new")), [id_])
    return df.join(m, id_, "left").withColumn(id_, F.coalesce("__new", F.col(id_))).drop("__new")


def tier3(power: DataFrame, meta: DataFrame, keys: list[str], channel: str, band: str, value: str, bands: list[str]) -> DataFrame:
    """Windowed power long by channel and window, one column per band, with
    the channel's regions."""
    wide = power.groupBy(*keys, channel).agg(*[F.max(F.when(F.col(band) == b, F.col(value))).alias(b) for b in bands])
    return wide.join(meta, channel, "left")


def tier4(t3: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Labelled features of each window joined to its power rows."""
    from tidegrid.operators.joins import merge_labels

    return merge_labels(t3, features, on, indicator="has_features")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
