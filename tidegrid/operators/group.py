"""Group statistics joined back, and exact quantiles for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import settle_summary

SMALL_GROUP = 65_536
SKETCH = 100_000
BRACKET = 5e-5


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row beside a global aggregate, which is a single row by construction."""
    return df.crossJoin(F.broadcast(one))


def with_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Add group aggregates to every row. The aggregate combines map-side; the
    join carries no hint, so the summary is broadcast only below the planner's
    size limit, and a skewed side is split above it. Without keys there is one
    row to add."""
    one = settle_summary(df.groupBy(*keys).agg(*[v.alias(n) for n, v in stats.items()]), df)
    return df.join(one, keys, "left") if keys else with_row(df, one)


def corr_of(a: str | Column, b: str | Column) -> Column:
    """Pearson r over the rows that have both, as an aggregate. NaN, as in SQL,
    where a side doesn't vary (a division by zero to F.corr); null without rows."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.when(spread != 0, F.covar_pop(a, b) / spread).when(spread == 0, float("nan"))


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two numbers of 26 bits, whose products are exact."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part as SQL's quantile_cont rounds it: the first
    product enters the sum unrounded. Where the two differ by rounding alone, any
    other order may end at the other of them, and a comparison with it flips."""
    rest = F.lit(1.0) - part
    (a1, a2), (b1, b2) = _halves(low), _halves(rest)
    p, c = low * rest, high * part
    lost = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    s = p + c
    back = s - p
    exact = s + (((p - (s - back)) + (c - back)) + lost)
    return F.when(part == 0, low).when(F.greatest(F.abs(low), F.abs(high)) < 1e290, exact).otherwise(s)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group.

    A mergeable sketch brackets each wanted rank; only rows inside the bracket
    are then counted value by value, rows below it collapse to one counter.
    Groups up to SMALL_GROUP rows are taken whole. A group holding a third of
    all rows therefore sends a ten-thousandth of itself to its task.
    """
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("__x")).filter(F.col("__x").isNotNull())
    wanted = list(probs.items())
    edges = [max(0.0, p - BRACKET) for _, p in wanted] + [min(1.0, p + BRACKET) for _, p in wanted]
    k = len(wanted)
    ends = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__x").alias("__min"),
        F.max("__x").alias("__max"),
        F.percentile_approx("__x", edges, F.lit(SKETCH)).alias("__q"),
    )
    whole = F.col("__n") <= SMALL_GROUP

    def edge(i: int, p: float, low: bool) -> Column:
        outer = F.col("__min" if low else "__max")
        open_end = p - BRACKET <= 0 if low else p + BRACKET >= 1
        return outer if open_end else F.when(whole, outer).otherwise(F.col("__q")[i if low else k + i])

    ends = ends.select(
        *keys,
        "__n",
        *[edge(i, p, True).alias(f"__lo{i}") for i, (_, p) in enumerate(wanted)],
        *[edge(i, p, False).alias(f"__hi{i}") for i, (_, p) in enumerate(wanted)],
    )
    ends = settle_summary(ends, base)
    rows = base.join(ends, keys) if keys else with_row(base, ends)
    if k == 1:
        rows = rows.select(*keys, "__n", F.lit(0).alias("__i"), "__x", F.col("__lo0").alias("__lo"), F.col("__hi0").alias("__hi"))
    else:
        marks = F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi")) for i in range(k)
        ])
        rows = rows.select(*keys, "__n", "__x", F.explode(marks).alias("__m")).select(
            *keys, "__n", F.col("__m.i").alias("__i"), "__x", F.col("__m.lo").alias("__lo"), F.col("__m.hi").alias("__hi")
        )
    cells = (
        rows.filter(F.col("__x") <= F.col("__hi"))
        .select(*keys, "__n", "__i", F.when(F.col("__x") >= F.col("__lo"), F.col("__x")).alias("__cell"))
        .groupBy(*keys, "__i", "__cell")
        .agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    )
    w = Window.partitionBy(*keys, "__i").orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("__cum", F.sum("__c").over(w))
    aggs = []
    for i, (name, p) in enumerate(wanted):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        mine = F.col("__i") == i
        missed = F.max(mine & F.col("__cell").isNull() & (F.col("__cum") > F.floor(pos)))
        at = F.min(F.when(mine & (F.col("__cum") > F.floor(pos)), F.col("__cell")))
        nxt = F.min(F.when(mine & (F.col("__cum") > F.ceil(pos)), F.col("__cell")))
        part = F.max(F.when(mine, pos - F.floor(pos)))
        ends = F.struct(at.alias("at"), nxt.alias("nxt"), part.alias("part"))
        aggs.append(F.when(missed | nxt.isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(ends).alias(name))
    got = cells.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[between(F.col(name)["at"], F.col(name)["nxt"], F.col(name)["part"]).alias(name) for name, _ in wanted])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank with ties sharing their mean rank, counted through distinct values."""
    from tidegrid.operators.scan import cut, scan

    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__ties"))
    if not keys:
        seen = seen.withColumn("__all", F.lit(0))
    seen = scan(cut(seen, keys or ["__all"], [value]), total={"__upto": F.col("__ties")})
    rank = F.col("__upto") - F.col("__ties") + (F.col("__ties") + 1) / F.lit(2.0)
    return df.join(seen.select(*keys, value, rank.alias(out)), [*keys, value], "left")
