"""Registry of queries over the given tables, with shared inputs and SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.scan import time_index
from tidegrid.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TABLES: dict[tuple[str, str], "Tables"] = {}

SIZE, STEP = 20, 5
DIMS = 64  # of an embedding


class Tables:
    """The driver's tables and the signal derived from `events`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def signal(self) -> DataFrame:
        """events as one series per user, indexed in time order. Stored once
        per application, as a stage output that many queries read."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        ev = self.events.select("event_id", F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), "value", us.alias("us"))
        start = ev.groupBy("recording").agg(F.min("us").alias("us0"))
        d = time_index(ev, ["recording"], ["us", "event_id"]).join(start, "recording")
        e = F.col("event_id")
        return settle(d.select(
            "recording", "channel", "event_id", "sample_idx", ((F.col("us") - F.col("us0")) / 1e6).alias("t"), "value",
            F.when(e % 7 != 0, F.col("value")).alias("gappy"),
            (e % 100).cast("double").alias("y"), (e % 5 != 0).alias("vl"), (e % 3 != 0).alias("vr"),
        ), "signal")

    @property
    def channels(self) -> DataFrame:
        """One series per (recording, channel)."""
        return self._channels

    @cached_property
    def _channels(self) -> DataFrame:
        d = time_index(self.signal.drop("sample_idx"), ["recording", "channel"], ["t", "event_id"])
        return settle(d.select("recording", "channel", "event_id", "sample_idx", "t", "value"), "channels")

    @cached_property
    def embedded(self) -> DataFrame:
        """embeddings as features over time: subject = label, time = rank."""
        d = time_index(self.embeddings.withColumn("v", F.col("vec_id").cast("double")), ["label"], ["v", "vec_id"], out="time_idx")
        return settle(d.select(F.col("label").alias("subject"), "time_idx", "vec_id", *[
            F.col("embedding")[i].cast("double").alias(f"f{i + 1}") for i in range(DIMS)]), "features")


def tables(spark: SparkSession, path: str) -> Tables:
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, path)
    return _TABLES[key]


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(tables(spark, path))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def nudge(digits: int) -> float:
    """Added before rounding on both sides: a mean of two-decimal values often
    ends in a 5 one digit past the cut, where the order of summation would
    decide which way it rounds."""
    return 3.7 * 10.0 ** -(digits + 4)


def r(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison, with no negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.round(c + F.lit(nudge(digits)), digits) + F.lit(0.0)
    return out.alias(col) if isinstance(col, str) else out


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c), digits) for c in cols})


# Shared SQL.
SIG = """sig AS (
  SELECT user_id AS recording, event_type AS channel, event_id, value, event_id % 100 + 0.0::DOUBLE AS y,
    CASE WHEN event_id % 7 <> 0 THEN value END AS gappy, event_id % 5 <> 0 AS vl, event_id % 3 <> 0 AS vr,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t
  FROM events)"""
CH = SIG + """, ch AS (
  SELECT recording, channel, event_id, t, value, row_number() OVER (PARTITION BY recording, channel ORDER BY t, event_id) - 1 AS sample_idx FROM sig)"""
WIN = SIG + f""", win AS (
  SELECT s.*, k.window_idx FROM sig s, LATERAL (
    SELECT unnest(range(greatest(0, CAST(ceil((s.sample_idx - {SIZE - 1}) / {STEP}.0) AS BIGINT)), s.sample_idx // {STEP} + 1)) AS window_idx) k)"""
EMB = "emb AS (SELECT label AS subject, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS time_idx, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i + 1}" for i in range(DIMS)) + " FROM embeddings)"
# One row per dimension.
EMBL = "el AS (SELECT label AS subject, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS time_idx, embedding FROM embeddings), " + \
    "ed AS (SELECT subject, vec_id, time_idx, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM el)"


def q(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr}) + {nudge(digits)!r}, {digits}) + 0.0 AS {name}"
