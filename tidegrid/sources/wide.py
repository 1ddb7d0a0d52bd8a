"""Wide files: text metadata rows above numeric window rows, one column per channel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.session import settle

ID_COLS = ["row_id", "SubID", "Atlas"]


def _numbered(raw: DataFrame, out: str) -> DataFrame:
    """Rows with their number over all files, by name and place. A task reads a
    block of a file from start to end, so a row's number is its place in the
    block after the counts of the blocks before; written once, as the place is
    known only where the file is read."""
    place = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__m": F.monotonically_increasing_id()}
    rows = settle(raw.select("*", *[c.alias(k) for k, c in place.items()]), "wide")
    blocks = rows.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    return rows.join(blocks, ["__file", "__block"]).withColumn(out, F.col("__m") + F.col("__shift")).drop("__file", "__block", "__m", "__shift")


def read_wide(spark: SparkSession, path: str, index: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(metadata, windows): metadata is (SubID, atlas, label, region); windows
    is (SubID, label, window_idx, value). Rows with Atlas set are metadata; text
    that is no number is missing.

    A file written with its index column keeps its row order by it. Without
    one, rows are numbered by their place in the file, however it is split.
    """
    raw = spark.read.option("header", True).csv(path)
    labels = [c for c in raw.columns if c not in (*ID_COLS, index) and not c.startswith("Unnamed")]
    if index in raw.columns:
        raw = raw.withColumn("__at", F.expr(f"try_cast(`{index}` as bigint)"))
    else:
        raw = _numbered(raw, "__at")
    raw = raw.select("__at", "SubID", "Atlas", *labels)
    meta = raw.filter(F.col("Atlas").isNotNull()).select("SubID", F.col("Atlas").alias("atlas"), *labels).unpivot(
        ["SubID", "atlas"], labels, "label", "region")
    rows = raw.filter(F.col("Atlas").isNull())
    first = rows.groupBy("SubID").agg(F.min("__at").alias("__first"))
    long = rows.unpivot(["__at", "SubID"], labels, "label", "__text")
    long = long.join(first, "SubID").select(
        "SubID", "label", (F.col("__at") - F.col("__first")).alias("window_idx"), F.expr("try_cast(__text as double)").alias("value"))
    return meta, long


def electrode_columns(columns: list[str], pattern: str = r"^[LR][A-Za-z0-9]+$") -> list[str]:
    import re

    return [c for c in columns if re.match(pattern, c)]


def to_wide(long: DataFrame, meta: DataFrame, subject: str, idx: str, label: str, value: str, channels: list[str],
            atlases: list[str]) -> DataFrame:
    """One text row per atlas, then one row per window, a column per channel in
    the order given. Channels missing from, or unknown to, the list are an
    error."""
    want = long.sparkSession.createDataFrame([(c,) for c in channels], f"{label} string")
    have = long.select(label).distinct()
    extra = [r[0] for r in have.join(want, label, "left_anti").limit(10).collect()]
    missing = [r[0] for r in want.join(have, label, "left_anti").limit(10).collect()]
    if extra or missing:
        raise ValueError(f"channels differ from the list: extra {extra}, missing {missing}")

    def pivoted(df, keys, col):
        # String keys: the file has text rows above the numbers.
        return df.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == c, F.col(col).cast("string"))).alias(c) for c in channels])

    rows = pivoted(long, [subject, idx], value).select(
        F.lit(1).alias("row_kind"), F.col(idx).cast("long").alias("row_idx"), F.col(subject).alias("SubID"), F.lit(None).cast("string").alias("Atlas"), *channels)
    heads = [
        pivoted(meta, [subject], a).select(
            F.lit(0).alias("row_kind"), F.lit(i).cast("long").alias("row_idx"), F.col(subject).alias("SubID"),
            F.lit(a if a == "network" else f"{a}_Region").alias("Atlas"), *channels)
        for i, a in enumerate(atlases)
    ]
    return reduce(DataFrame.unionByName, [*heads, rows]).orderBy("row_kind", "SubID", "row_idx")


def write_wide(wide: DataFrame, path: str) -> None:
    """CSV with a row_id that keeps the order: text rows below zero."""
    row_id = F.when(F.col("row_kind") == 0, F.col("row_idx") - 1000).otherwise(F.col("row_idx")).alias("row_id")
    wide.select(row_id, *[c for c in wide.columns if c not in ("row_kind", "row_idx")]).write.mode("overwrite").option("header", True).csv(path)


def split_wide_rows(df: DataFrame, atlas: str, labels: list[str]) -> DataFrame:
    """Metadata rows of an already loaded wide table, long."""
    return df.filter(F.col(atlas).isNotNull()).unpivot([atlas], labels, "label", "region")
