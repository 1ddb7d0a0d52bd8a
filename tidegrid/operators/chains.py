"""Sequential rules over series of any length in a logarithmic number of rounds.

A rule that hands one value from row to row is a chain of functions. Where the
functions compose, pieces are summed up side by side and only their sums meet:

* `leap` keeps a row when it comes at least `gap` after the last kept one. The
  next kept row is a pointer; what leaves a piece is one of a few rows, those
  with no later row of the piece at least `gap` away, and pointers between such
  rows are doubled.
* `clamped` runs x -> min(max(x, low), high) along a series. Two such steps are
  again one, so a piece is one pair of bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.scan import SEG, SEGMENT_ROWS, Cut, cut, pieces, scan
from tidegrid.session import settle

FAR = 1 << 62


def _next(t: np.ndarray, x: np.ndarray, gap: float) -> np.ndarray:
    """For each x the first place in ascending t with t - x >= gap."""
    j = np.searchsorted(t, x + gap)
    # x + gap is rounded, t - x is what counts.
    while len(low := np.flatnonzero((j < len(t)) & (t[np.minimum(j, len(t) - 1)] - x < gap))):
        j[low] = np.searchsorted(t, t[j[low]], "right")
    while len(high := np.flatnonzero((j > 0) & (t[j - 1] - x >= gap))):
        j[high] = np.searchsorted(t, t[j[high] - 1])
    return j


def _exits(t: np.ndarray, gap: float) -> np.ndarray:
    """For each row, if it is kept: the last row of the piece that is kept then."""
    n, at = len(t), np.arange(len(t))
    j = _next(t, t, gap)
    to = np.where((j < n) & (j > at), j, at)
    while not (to == (further := to[to])).all():
        to = further
    return to


def _orbit(t: np.ndarray, start: int, gap: float) -> list[int]:
    """The kept rows from `start` on."""
    out, n = [], len(t)
    while start < n:
        out.append(start)
        now = start
        start = int(_next(t[now + 1 :], t[now : now + 1], gap)[0]) + now + 1 if now + 1 < n else n
    return out


def _sorted(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*names).sortWithinPartitions(*names, *order)


def _slices(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    for table, starts in pieces(batches, names):
        yield table, list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]))


def leap(c: Cut, t: str, gap: float) -> DataFrame:
    """The rows kept when each must come at least `gap` (> 0) after the last kept
    one; the first row of a series is kept. `t` leads the order and is not null.

    One piece a series: one pass. Otherwise three passes over the rows, and
    log2(pieces) doublings of a small table: per piece, the rows within `gap` of
    its end."""
    names = [*c.keys, SEG]
    out_cols = [x for x in c.df.columns if x != SEG]
    types = dict(c.df.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in names)

    def emit(batches):
        for table, parts in _slices(batches, names):
            v = table.column("__at").to_numpy()
            carry = table.column("__carry").to_numpy() if "__carry" in table.column_names else None
            picks = []
            for a, b in parts:
                x = v[a:b]
                first = 0 if carry is None or np.isnan(carry[a]) else int(_next(x, carry[a : a + 1], gap)[0])
                picks += [a + i for i in _orbit(x, first, gap)]
            yield from table.take(pa.array(picks, pa.int64())).select(out_cols).to_batches()

    out_schema = ", ".join(f"`{x}` {types[x]}" for x in out_cols)
    rows = c.df.withColumn("__at", F.col(t).cast("double"))
    if c.single:
        return _sorted(rows, names, c.order).mapInArrow(emit, out_schema)

    slim = rows.select(*names, F.col("__at").alias("__x"))

    def leaving(batches):
        for table, parts in _slices(batches, names):
            v = table.column("__x").to_numpy()
            heads, xs, first = [], [], []
            for a, b in parts:
                to = _exits(v[a:b], gap)
                x = np.unique(v[a:b][to])
                heads.append(np.full(len(x), a)), xs.append(x), first.append(x == v[a + to[0]])
            got = table.take(pa.array(np.concatenate(heads))).select(names)
            yield from got.append_column("__x", pa.array(np.concatenate(xs))).append_column("__first", pa.array(np.concatenate(first))).to_batches()

    nodes = settle(_sorted(slim, names, ["__x"]).mapInArrow(leaving, f"{key_schema}, __x double, __first boolean"), "exits")
    along = Window.partitionBy(*c.keys).orderBy(SEG)
    ends = rows.groupBy(*names).agg(F.max("__at").alias("__end"))
    here = F.struct(F.col(SEG).alias("seg"), F.col("__end").alias("end"))
    ends = settle(ends.select(*names, "__end", F.lag(here).over(along).alias("__before"), here.alias("__here"), F.lead(here).over(along).alias("__after"), F.row_number().over(along).alias("__n")), "ends")
    # The piece of the next kept row: the first one that ends at least `gap` after.
    # Looked up by the rounded sum, then corrected to the difference.
    both = nodes.select(*names, "__x", (F.col("__x") + gap).alias("__p"), F.lit(0).alias("__side")).unionByName(
        ends.select(*names, F.col("__end").alias("__p"), F.lit(1).alias("__side"), F.struct("__before", "__here", "__after").alias("__three")), allowMissingColumns=True)
    seen = scan(cut(both.withColumnRenamed(SEG, "__from"), c.keys, ["__p", "__side", "__from"]), first_from={"__three": F.col("__three")})
    x = F.col("__x")
    to = F.coalesce(*[F.when(F.col(f"__three.{w}.end") - x >= gap, F.col(f"__three.{w}.seg")) for w in ("__before", "__here", "__after")])
    met = seen.where("__side = 0").select(*c.keys, to.alias(SEG), "__from", "__x").where(F.col(SEG).isNotNull())

    def arriving(batches):
        for table, parts in _slices(batches, names):
            v, is_row, came = table.column("__x").to_numpy(), table.column("__row").to_numpy(zero_copy_only=False).astype(bool), table.column("__from").to_numpy()
            heads, now, since, to_x = [], [], [], []
            for a, b in parts:
                k = a + int((~is_row[a:b]).sum())  # what arrives stands before the rows
                to = _exits(v[k:b], gap)
                entry = _next(v[k:b], v[a:k], gap)
                heads.append(np.full(k - a, a)), now.append(v[a:k]), since.append(came[a:k]), to_x.append(v[k:b][to[entry]] if k > a else v[:0])
            got = table.take(pa.array(np.concatenate(heads))).select(names)
            for n, col, kind in (("__from", since, pa.int64()), ("__x", now, pa.float64()), ("__to", to_x, pa.float64())):
                got = got.append_column(n, pa.array(np.concatenate(col).astype(kind.to_pandas_dtype()), kind))
            yield from got.to_batches()

    mixed = slim.withColumns({"__from": F.lit(-1).cast("long"), "__row": F.lit(True)}).unionByName(met.withColumn("__row", F.lit(False)))
    edges = _sorted(mixed.select(*names, "__from", "__x", "__row"), names, ["__row", "__x"]).mapInArrow(arriving, f"{key_schema}, __from long, __x double, __to double")
    jump = settle(edges.select(*c.keys, F.col("__from").alias(SEG), "__x", F.col(SEG).alias("__seg2"), F.col("__to").alias("__x2")), "jumps")
    path = nodes.where("__first").join(ends.where("__n = 1").select(*names), names).select(*names, "__x")
    most = ends.agg(F.max("__n")).first()[0] or 1
    for k in range(max(0, int(most - 1).bit_length())):
        # The path so far and every node 2**k steps on; then steps twice as long.
        path = settle(path.unionAll(path.join(jump, [*names, "__x"]).select(*c.keys, F.col("__seg2").alias(SEG), F.col("__x2").alias("__x"))), "jumps")
        if 2 << k < most:
            ahead = jump.select(*c.keys, F.col(SEG).alias("__seg2"), F.col("__x").alias("__x2"), F.col("__seg2").alias("__seg3"), F.col("__x2").alias("__x3"))
            jump = settle(jump.join(ahead, [*c.keys, "__seg2", "__x2"]).select(*names, "__x", F.col("__seg3").alias("__seg2"), F.col("__x3").alias("__x2")), "jumps")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*names).join(path, names, "left").select(*names, F.last("__x", True).over(before).alias("__carry"))
    return _sorted(rows.join(carry, names), names, c.order).mapInArrow(emit, out_schema)


def _scan_clamps(low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all steps from the first of its piece up to each; `start` is
    each row's first row. Distances double, so log2(rows) array operations."""
    at, d = np.arange(len(low)), 1
    low, high = low.copy(), high.copy()
    while d < len(low):
        i = np.flatnonzero(at - d >= start)
        if not len(i):
            break
        a, b = low[i - d], high[i - d]
        low[i], high[i] = np.minimum(np.maximum(a, low[i]), high[i]), np.minimum(np.maximum(b, low[i]), high[i])
        d *= 2
    return low, high


def clamped(df: DataFrame, keys: list[str], idx: str, low: Column, high: Column, out: str, before: str, initial: int = 0, rows: int | None = None) -> DataFrame:
    """Along each series, ordered by the 0-based index `idx`: out = min(max(x,
    low), high) of the value x before, which is `before`; `initial` at first.
    Bounds are long, low <= high. Two passes, whatever the number of pieces."""
    rows = rows or SEGMENT_ROWS
    names = [*keys, SEG]
    d = df.withColumns({SEG: F.floor(F.col(idx) / F.lit(rows)).cast("long"), "__low": low.cast("long"), "__high": high.cast("long")})
    types = dict(d.dtypes)
    cols = [x for x in d.columns if x not in ("__low", "__high")]

    def run(batches):
        for table, starts in pieces(batches, names):
            size = np.diff(np.append(starts, table.num_rows))
            first = np.repeat(starts, size)
            lo, hi = _scan_clamps(table.column("__low").to_numpy(), table.column("__high").to_numpy(), first)
            lo0, hi0 = np.append(-FAR, lo[:-1]), np.append(FAR, hi[:-1])
            lo0[starts], hi0[starts] = -FAR, FAR
            got = table.select(cols)
            for n, v in (("__low", lo), ("__high", hi), ("__low0", lo0), ("__high0", hi0)):
                got = got.append_column(n, pa.array(v))
            yield from got.to_batches()

    schema = ", ".join(f"`{x}` {types[x]}" for x in cols) + ", __low long, __high long, __low0 long, __high0 long"
    steps = settle(_sorted(d, names, [idx]).mapInArrow(run, schema), "steps")
    # One pair of bounds per piece, composed along the series.
    last = steps.groupBy(*names).agg(F.max_by(F.struct("__low", "__high"), F.col(idx)).alias("__b")).select(*names, "__b.*")

    def prefix(batches):
        for table, starts in pieces(batches, keys):
            size = np.diff(np.append(starts, table.num_rows))
            lo, hi = _scan_clamps(table.column("__low").to_numpy(), table.column("__high").to_numpy(), np.repeat(starts, size))
            value = np.append(initial, np.minimum(np.maximum(initial, lo), hi)[:-1])
            value[starts] = initial
            yield from table.select(names).append_column("__in", pa.array(value.astype(np.int64))).to_batches()

    carry = _sorted(last, keys, [SEG]).mapInArrow(prefix, ", ".join(f"`{k}` {types[k]}" for k in names) + ", __in long")
    x = F.col("__in")
    kept = [c for c in df.columns if c not in (out, before)]
    return steps.join(carry, names).select(
        *kept, F.least(F.greatest(x, "__low0"), "__high0").alias(before), F.least(F.greatest(x, "__low"), "__high").alias(out))
