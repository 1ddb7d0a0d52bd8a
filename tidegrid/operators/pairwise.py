"""Every pair of entities over their shared times, in tiles of the pair matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import pieces, time_index
from tidegrid.session import settle

#: Entities on a side of a tile, and times of a block.
TILE, BLOCK = 256, 4096
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
ENDS = {"lx": F.min, "hx": F.max, "ly": F.min, "hy": F.max}
#: Relative range up to which a series counts as constant: sums of equal values
#: in another order differ by as much.
NOISE = 1e-11


def _numbered(base: DataFrame, by: list[str], entity: str, tile: int, centre: bool) -> DataFrame:
    """by, entity, its tile, the number of tiles of its group, its mean (0 if values
    are not to be centred) and its largest size."""
    mean = F.avg("__v") if centre else F.lit(0.0)
    one = settle(base.groupBy(*by, entity).agg(mean.alias("__mean"), F.max(F.abs("__v")).alias("__peak")), "entities")
    one = time_index(one, by, [entity], out="__rank").withColumn("__tile", F.floor(F.col("__rank") / tile).cast("int"))
    tiles = one.groupBy(*by).agg((F.max("__tile") + 1).alias("__tiles"))
    return one.join(tiles, by).drop("__rank")


def _extremes(x: np.ndarray, m: np.ndarray, k: np.ndarray, mean: np.ndarray, peak: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each left entity over the times it shares with
    each right one, looked up only where its sums leave open whether it varies
    there; infinite where they show that it does."""
    low, high = np.full(n.shape, -np.inf), np.full(n.shape, np.inf)
    spread = ss - s * s / np.maximum(n, 1)
    open_ = (n > 0) & ((spread <= 1e-6 * ss) | (spread <= n * (1e-9 * peak[:, None]) ** 2))
    for i in np.flatnonzero(open_.any(axis=1)):
        j, at = np.flatnonzero(open_[i]), m[:, i] > 0
        v, met = (x[at, i] + mean[i])[:, None], k[np.ix_(at, j)] > 0
        low[i, j], high[i, j] = np.where(met, v, np.inf).min(axis=0), np.where(met, v, -np.inf).max(axis=0)
    return low, high


def pairwise_moments(df: DataFrame, by: list[str], entity: str, time: str, value: str, block: int | None = None, tile: int | None = None,
                     centre: bool = True, diagonal: bool = False) -> DataFrame:
    """Sums over shared times for every pair of entities a < b within `by` (a <= b
    with `diagonal`): n, sx, sy, sxx, syy, sxy, over pairwise complete samples, and
    lx, hx, ly, hy, the least and largest of each side's own values over them
    (infinite where a block's sums show that it varies).
    Each entity's values are taken less its mean unless `centre` is off, so that
    sums of squares don't cancel whatever the level, and those of the blocks add up.

    A group is cut into blocks of time and its entities into tiles; a task
    multiplies two small time-by-entity matrices and sends one row per pair, not
    one per sample. A row goes to as many tasks as its group has tiles. `time` is
    an integer index, `by` names one column at least; rows with a null there, or
    without an entity or value, go.
    """
    block, tile = block or BLOCK, tile or TILE
    types = dict(df.dtypes)
    base = df.select(*by, entity, F.col(time).alias("__time"), F.col(value).cast("double").alias("__v")).dropna(subset=[*by, entity, "__v"])
    rows = base.join(_numbered(base, by, entity, tile, centre), [*by, entity]).withColumn("__v", F.col("__v") - F.col("__mean"))
    other = F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__other")
    rows = rows.select(*by, entity, "__time", "__v", "__mean", "__peak", "__tile", F.floor(F.col("__time") / block).alias("__block"), other)
    rows = rows.withColumns({"__lo": F.least("__tile", "__other"), "__hi": F.greatest("__tile", "__other")}).drop("__other")
    group = [*by, "__block", "__lo", "__hi"]

    def side(who: np.ndarray, at: np.ndarray, v: np.ndarray, mean: np.ndarray, peak: np.ndarray, n_times: int) -> tuple[np.ndarray, ...]:
        names, one, j = np.unique(who, return_index=True, return_inverse=True)
        x, m = np.zeros((n_times, len(names))), np.zeros((n_times, len(names)))
        x[at, j], m[at, j] = v, 1.0
        return names, x, m, mean[one], peak[one]

    def sums(batches):
        for table, starts in pieces(batches, group):
            who, when, v, mean, peak, mine, lo, hi = (table.column(c).to_numpy() for c in (entity, "__time", "__v", "__mean", "__peak", "__tile", "__lo", "__hi"))
            kind = table.schema.field(entity).type
            heads, a, b, out = [], [], [], {m: [] for m in (*SUMS, *ENDS)}
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                times, at = np.unique(when[s:e], return_inverse=True)
                first = mine[s:e] == lo[s]
                left = side(*(c[s:e][first] if c is not at else at[first] for c in (who, at, v, mean, peak)), len(times))
                same = lo[s] == hi[s]
                right = left if same else side(*(c[s:e][~first] if c is not at else at[~first] for c in (who, at, v, mean, peak)), len(times))
                (na, x, m, *u), (nb, y, k, *w) = left, right
                n = m.T @ k
                met = n > 0
                if same:
                    met &= np.triu(np.ones(met.shape, bool), 0 if diagonal else 1)
                i, j = np.nonzero(met)
                heads.append(np.full(len(i), s))
                a.append(na[i]), b.append(nb[j])
                sx, sy, sxx, syy = x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y)
                ends = [*_extremes(x, m, k, *u, n, sx, sxx), *(g.T for g in _extremes(y, k, m, *w, n.T, sy.T, syy.T))]
                for name, g in zip(out, (n, sx, sy, sxx, syy, x.T @ y, *ends)):
                    out[name].append(g[i, j])
            rows = table.take(pa.array(np.concatenate(heads))).select(by)
            rows = rows.append_column("a", pa.array(np.concatenate(a), type=kind)).append_column("b", pa.array(np.concatenate(b), type=kind))
            for name in out:
                rows = rows.append_column(name, pa.array(np.concatenate(out[name])))
            yield from rows.to_batches()

    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + [f"a {types[entity]}", f"b {types[entity]}"] + [f"{m} double" for m in (*SUMS, *ENDS)])
    parts = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(sums, schema)
    return parts.groupBy(*by, "a", "b").agg(*[F.sum(s).alias(s) for s in SUMS], *[f(s).alias(s) for s, f in ENDS.items()])


def moments_corr() -> Column:
    """Pearson r from pairwise moments; null where a side is constant over
    the times both have, but for rounding."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    r = (F.col("sxy") - sx * sy / n) / (F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))

    def varies(low: str, high: str) -> Column:
        lo, hi = F.col(low), F.col(high)
        return (hi == float("inf")) | (hi - lo > NOISE * F.greatest(F.abs(lo), F.abs(hi)))

    spread = (vx > 0) & (vy > 0) & varies("lx", "hx") & varies("ly", "hy")
    return F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
