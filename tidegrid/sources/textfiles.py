"""Line-based inputs: stimulus logs and bad-channel lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a stimulus start looks like in the log.
VISUAL_START = r"^\s*(\d+\.\d+)\s+EXP\s+(visual_(standard|deviant)):\s+autoDraw\s+=\s+True"
AUDIO_START = r"^\s*(\d+\.\d+)\s+EXP\s+Sound\s+(audio_(standard|deviant))\s+started"


def parse_stim_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Stimulus start events of a log; ends and everything else are ignored."""
    line = F.col(text)

    def part(group: int) -> Column:
        seen = F.regexp_extract(line, VISUAL_START, group)
        heard = F.regexp_extract(line, AUDIO_START, group)
        return F.when(seen != "", seen).when(heard != "", heard)

    rest = [c for c in lines.columns if c != text]
    d = lines.select(
        *rest, part(1).cast("double").alias("time_s"),
        F.when(line.rlike(VISUAL_START), "visual").when(line.rlike(AUDIO_START), "auditory").alias("modality"),
        part(3).alias("condition"), part(2).alias("stimulus"), F.lit("start").alias("event"), F.trim(line).alias("raw_line"),
    )
    return d.filter(F.col("time_s").isNotNull())


def read_stim_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_stim_log(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source")))


def parse_bad_channels(lines: DataFrame, text: str = "value") -> DataFrame:
    """One label per line; '#' lines and blanks are headers."""
    label = F.trim(F.col(text))
    return lines.select(*[c for c in lines.columns if c != text], label.alias("label")).filter(
        (F.col("label") != "") & ~F.col("label").startswith("#"))


def read_bad_channels(spark: SparkSession, path: str) -> DataFrame:
    return parse_bad_channels(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source")))


def merge_bad_channels(listed: DataFrame, recorded: DataFrame, known: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """File list first, then the recorded list, each in its own order; labels
    the recording does not have are dropped, repeats keep their first place."""
    both = listed.select(*keys, label, F.struct(F.lit(0).alias("s"), F.col(order).cast("long").alias("o")).alias("__at")).unionByName(
        recorded.select(*keys, label, F.struct(F.lit(1).alias("s"), F.col(order).cast("long").alias("o")).alias("__at")))
    once = both.groupBy(*keys, label).agg(F.min("__at").alias("__at"))
    return once.join(known.select(*keys, label).distinct(), [*keys, label], "left_semi").select(
        *keys, label, F.col("__at.s").alias("source_rank"), F.col("__at.o").alias("source_order"))
