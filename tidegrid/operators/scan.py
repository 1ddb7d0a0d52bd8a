"""Ordered work on series of any length.

A series is cut along its order into pieces of about SEGMENT_ROWS rows. Work
inside a piece is an ordinary window; what a piece needs from its neighbours
is either a halo of rows (bounded frames) or a carry taken from one summary
row per piece (running totals, last value seen). So no task ever holds a whole
series, even when one series has a third of all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import settle

SEGMENT_ROWS = 200_000
SEG = "__seg"


#: Range partitions of a cut; a partition of more rows than a piece is cut again.
MAX_PIECES = 20_000
PER_RANGE = 1 << 20


@dataclass(frozen=True)
class Cut:
    """Rows tagged with the piece they belong to. `order` is a total order of
    ascending columns within `keys`; `single` says every series is one piece,
    `placed` that the rows of a series are in one partition already."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    single: bool = False
    placed: bool = False

    def window(self, descending: bool = False):
        cols = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, SEG).orderBy(*cols)


def cut(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> Cut:
    """Cut an irregular series. If no series is longer than `rows` each is one
    piece. Otherwise rows are range-partitioned on (keys, order), MAX_PIECES
    partitions at most, and each sorted partition is cut every `rows` rows: pieces
    stay small whatever the total, and even whatever the timestamps do, as a
    series, a burst or even a single instant may be split. The ranges come from
    a sample, so the tagged rows are written once and all later passes read the
    same pieces."""
    rows = rows or SEGMENT_ROWS
    longest, total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (longest or 0) <= rows:
        return Cut(df.withColumn(SEG, F.lit(0).cast("long")), list(keys), list(order), True)
    n = min(-(-total // rows), MAX_PIECES)
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id holds the partition and, in its lower 33 bits, the row's place in it.
    place = F.monotonically_increasing_id()
    piece = F.shiftright(place, 33) * F.lit(PER_RANGE) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows))
    return Cut(settle(ranged.withColumn(SEG, piece.cast("long")), "pieces"), list(keys), list(order))


def cut_dense(df: DataFrame, keys: list[str], idx: str, rows: int | None = None) -> Cut:
    """Cut a series whose order is a 0-based sample index: no look at the data."""
    rows = rows or SEGMENT_ROWS
    return Cut(df.withColumn(SEG, F.floor(F.col(idx) / F.lit(rows)).cast("long")), list(keys), [idx])


def short(df: DataFrame, idx: str, rows: int | None = None) -> bool:
    """Whether a 0-based sample index stays within one piece in every series."""
    top = df.agg(F.max(idx)).first()[0]
    return top is None or top < (rows or SEGMENT_ROWS)


def whole(df: DataFrame, keys: list[str], idx: str, placed: bool = False) -> Cut:
    """Every series as one piece: for an index that is `short`."""
    return Cut(df.withColumn(SEG, F.lit(0).cast("long")), list(keys), [idx], True, placed)


def scan(
    c: Cut,
    *,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    first_from: dict[str, Column] | None = None,
    first_after: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    least_from: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values along each series, all in one pass over the pieces.

    last / last_before: latest non-null value up to / before the row;
    first_from / first_after: next non-null value from / after the row;
    total: running sum including the row;
    least_from: smallest non-null value from the row on.
    """
    back = {**(last or {}), **(last_before or {})}
    ahead = {**(first_from or {}), **(first_after or {})}
    sums, least = total or {}, least_from or {}
    src = {n: f"__v_{n}" for n in [*back, *ahead, *sums, *least]}
    df = c.df
    for n, col in [*back.items(), *ahead.items(), *sums.items(), *least.items()]:
        df = df.withColumn(src[n], col)

    def carried(n: str, local: Column, combine) -> Column:
        return local if c.single else combine(local, F.col(f"__c_{n}"))

    if not c.single:
        place = F.struct(*c.order)
        aggs = []
        for n in back:
            v = F.col(src[n])
            aggs.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"__s_{n}"))
        for n in ahead:
            v = F.col(src[n])
            aggs.append(F.min_by(v, F.when(v.isNotNull(), place)).alias(f"__s_{n}"))
        for n in sums:
            aggs.append(F.sum(src[n]).alias(f"__s_{n}"))
        for n in least:
            aggs.append(F.min(src[n]).alias(f"__s_{n}"))
        seg_up = Window.partitionBy(*c.keys).orderBy(F.col(SEG)).rowsBetween(Window.unboundedPreceding, -1)
        seg_down = Window.partitionBy(*c.keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = df.groupBy(*c.keys, SEG).agg(*aggs)
        carry = carry.select(
            *c.keys,
            SEG,
            *[F.last(f"__s_{n}", True).over(seg_up).alias(f"__c_{n}") for n in back],
            *[F.last(f"__s_{n}", True).over(seg_down).alias(f"__c_{n}") for n in ahead],
            *[F.coalesce(F.sum(f"__s_{n}").over(seg_up), F.lit(0)).alias(f"__c_{n}") for n in sums],
            *[F.min(f"__s_{n}").over(seg_down).alias(f"__c_{n}") for n in least],
        )
        df = df.join(carry, [*c.keys, SEG], "left")

    up, down = c.window(), c.window(descending=True)
    start = Window.unboundedPreceding
    out: dict[str, Column] = {}
    for n in back:
        w = up.rowsBetween(start, 0 if n in (last or {}) else -1)
        out[n] = carried(n, F.last(src[n], True).over(w), F.coalesce)
    for n in ahead:
        w = down.rowsBetween(start, 0 if n in (first_from or {}) else -1)
        out[n] = carried(n, F.last(src[n], True).over(w), F.coalesce)
    for n in sums:
        out[n] = carried(n, F.coalesce(F.sum(src[n]).over(up.rowsBetween(start, 0)), F.lit(0)), Column.__add__)
    for n in least:
        out[n] = carried(n, F.min(src[n]).over(down.rowsBetween(start, 0)), F.least)
    kept = [col for col in c.df.columns if col != SEG and col not in out]
    return df.select(*kept, *[v.alias(n) for n, v in out.items()])


def framed(
    df: DataFrame,
    keys: list[str],
    idx: str,
    before: int,
    after: int,
    cols: Callable[[Window], dict[str, Column]],
    rows: int | None = None,
) -> DataFrame:
    """Columns over the frame [idx - before, idx + after] of an integer index.

    Rows near a piece's edge are copied to the neighbour that looks at them,
    so every frame is whole.
    """
    rows = rows or SEGMENT_ROWS
    i = F.col(idx)
    lo = F.greatest(F.floor((i - F.lit(after)) / F.lit(rows)), F.lit(0))
    hi = F.greatest(F.floor((i + F.lit(before)) / F.lit(rows)), lo)
    spread = df.withColumn(SEG, F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    w = Window.partitionBy(*keys, SEG).orderBy(F.col(idx).cast("long")).rangeBetween(-before, after)
    out = cols(w)
    kept = [c for c in df.columns if c not in out]
    return (
        spread.select(*kept, SEG, *[v.alias(n) for n, v in out.items()])
        .filter(F.floor(F.col(idx) / F.lit(rows)) == F.col(SEG))
        .drop(SEG)
    )


def time_index(df: DataFrame, keys: list[str], order: list[str], out: str = "sample_idx",
               rows: int | None = None) -> DataFrame:
    """0-based position of each row in its series."""
    df = scan(cut(df, keys, order, rows), total={out: F.lit(1).cast("long")})
    return df.withColumn(out, F.col(out) - 1)


Kernel = Callable[[dict[str, np.ndarray], object], tuple[np.ndarray, dict[str, np.ndarray], object]]
#: Columns of many pieces, one after the other, and which rows open a piece.
Fresh = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole pieces, with each piece's first row.
    At most one unfinished piece waits for the next batch."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([tail, table]) if tail is not None else table
        if table.num_rows == 0:
            continue
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in names:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        tail = table.slice(starts[-1])
    if tail is not None:
        yield tail, np.array([0])


def fold(c: Cut, kernel: Kernel, use: list[str], extra: dict[str, str] | None = None, fresh: Fresh | None = None) -> DataFrame:
    """A sequential rule over each series, exact for any length.

    `kernel(columns `use` of one piece in order, carry)` returns the positions
    of the rows to keep, one array per `extra` column (name -> type) for them,
    and the carry for the next piece: any JSON value, None at the start. Every
    piece is first run as if nothing came before it; pieces whose incoming carry
    then turns out different are run again until no carry changes. Rules that
    forget (debounce, response queues) settle in a round or two; a rule that
    never forgets still ends, after as many rounds as it has pieces. Each round
    writes one small row per piece to the shared folder.

    `fresh`, for rules that keep every row, does the same for all pieces of a
    batch in one call where no series has a second piece, so that millions of
    short series don't cost a call each.
    """
    keys, order, extra = c.keys, c.order, extra or {}
    names = [*keys, SEG]
    out_cols = [x for x in c.df.columns if x != SEG and x not in extra]
    types = dict(c.df.dtypes)

    def run(batches):
        for table, starts in pieces(batches, names):
            cols = {u: table.column(u).to_numpy() for u in use}
            carries = table.column("__carry").to_pylist() if "__carry" in table.column_names else None
            ends = [*starts[1:], table.num_rows]
            done = []
            for a, b in zip(starts, ends):
                carry = json.loads(carries[a]) if carries and carries[a] is not None else None
                picks, more, after = kernel({u: v[a:b] for u, v in cols.items()}, carry)
                done.append((a + np.asarray(picks, dtype=np.int64), more, after))
            yield table, starts, done

    def emit_fresh(batches):
        for table, starts in pieces(batches, names):
            opens = np.zeros(table.num_rows, dtype=bool)
            opens[starts] = True
            more = fresh({u: table.column(u).to_numpy() for u in use}, opens)
            kept = table.select(out_cols)
            for n, ty in extra.items():
                kept = kept.append_column(n, pa.array(more[n], type=ARROW[ty]))
            yield from kept.to_batches()

    def emit(batches):
        for table, _, done in run(batches):
            kept = table.take(pa.array(np.concatenate([d[0] for d in done]))).select(out_cols)
            for n, ty in extra.items():
                kept = kept.append_column(n, pa.array(np.concatenate([np.asarray(d[1][n]) for d in done]), type=ARROW[ty]))
            yield from kept.to_batches()

    def pass_on(batches):
        for table, starts, done in run(batches):
            heads = table.take(pa.array(starts)).select(names)
            after = [None if d[2] is None else json.dumps(d[2]) for d in done]
            yield from heads.append_column("__carry", pa.array(after, type=pa.string())).to_batches()

    def in_order(df):
        return (df if c.placed else df.repartition(*names)).sortWithinPartitions(*names, *order)

    schema = ", ".join([f"`{x}` {types[x]}" for x in out_cols] + [f"`{n}` {ty}" for n, ty in extra.items()])
    # Written once: the look at the piece numbers and every round read this table.
    rows = c.df if c.single else settle(c.df, "rows")
    if c.single or rows.filter(F.col(SEG) > 0).isEmpty():
        return in_order(rows).mapInArrow(emit_fresh if fresh else emit, schema)

    carry_schema = ", ".join(f"`{k}` {types[k]}" for k in names) + ", __carry string"
    order_of = Window.partitionBy(*keys).orderBy(SEG)
    chain = settle(rows.select(*names).distinct().withColumn("__next", F.lead(SEG).over(order_of)), "pieces")
    todo = chain.select(*names, F.lit(None).cast("string").alias("__carry"))
    known = todo
    while True:
        sent = (
            in_order(rows.join(todo, names)).mapInArrow(pass_on, carry_schema)
            .join(chain, names).filter(F.col("__next").isNotNull())
            .select(*keys, F.col("__next").alias(SEG), F.col("__carry").alias("__new"))
        )
        merged = settle(
            known.join(sent.withColumn("__hit", F.lit(True)), names, "left").select(
                *names,
                F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("__carry")).alias("__carry"),
                (F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col("__new").eqNullSafe(F.col("__carry"))).alias("__moved"),
            ),
            "carry",
        )
        known = merged.select(*names, "__carry")
        todo = merged.filter("__moved").select(*names, "__carry")
        if todo.isEmpty():
            break
    return in_order(rows.join(known, names)).mapInArrow(emit, schema)
