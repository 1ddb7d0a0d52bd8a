"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import settle


#: Shares of an id's links: a hub's links meet in as many tasks.
SHARES = 64


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links (u, v) with m, the smallest v of their u; and (u, m) alone.

    The links of an id are dealt to shares by their other end. A share is
    reduced to its minimum, the minima of all shares to that of the id, and this
    goes back to each share, so no task holds more than a share of a hub."""
    links = links.withColumn("share", F.expr(f"pmod(xxhash64(v), {SHARES})"))
    part = links.groupBy("u", "share").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"))
    return links.join(part.select("u", "share").join(low, "u"), ["u", "share"]).drop("share"), low


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every id with a link to another: label is the smallest id
    reachable. Links may repeat, point either way or to themselves.

    Alternates two steps until nothing changes: every id hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. The link
    table never grows, ends as stars, and is written each round, so a lost
    executor repeats one round. A hub's links are reduced and joined in shares."""
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = _with_least(both)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined, low = _with_least(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = settle(small.where("u <> v").distinct(), "links")
        h = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == (h["n"], h["h"]):
            break
        before = h["n"], h["h"]
    labels = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    return labels.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
