"""Joins: dimension lookups with guards, nearest in time, intervals, responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.chains import clamped
from tidegrid.operators.pairwise import moments_corr, pairwise_moments
from tidegrid.operators.scan import cut, scan
from tidegrid.session import settle


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; raises if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicated key {keys}: {[tuple(r)[:-1] for r in twice]}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def attach_meta(df: DataFrame, meta: DataFrame, on: list[str], strict: bool = True,
                fill: str = "Unknown") -> DataFrame:
    """Channel metadata joined on. Strict: a channel missing from the sheet is
    an error naming it. Lenient: its text columns read `fill`."""
    if strict:
        missing = df.select(*on).distinct().join(meta, on, "left_anti").limit(10).collect()
        if missing:
            raise ValueError(f"absent from metadata: {[tuple(r) for r in missing]}")
        return df.join(meta, on)
    text = [n for n, t in meta.dtypes if t == "string" and n not in on]
    return df.join(meta, on, "left").fillna(fill, subset=text)


def merge_labels(left: DataFrame, right: DataFrame, on: list[str], validate: bool = True,
                 indicator: str = "matched") -> DataFrame:
    """Left join many-to-one with a match flag."""
    if validate:
        assert_unique(right, on)
    marked = right.withColumn(indicator, F.lit(True))
    return left.join(marked, on, "left").withColumn(indicator, F.coalesce(indicator, F.lit(False)))


def unmatched(left: DataFrame, right: DataFrame, on: list[str], show: list[str] | None = None) -> DataFrame:
    show = show or on
    return left.join(right, on, "left_anti").select(*show).distinct().orderBy(*show)


def merge_wide(tables: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """One-to-one outer merge of several label sets: one column per set. One
    shuffle over the union, not a chain of outer joins."""
    long = reduce(
        DataFrame.unionByName,
        [d.select(*on, F.lit(n).alias("__set"), F.col(value).alias("__v")) for n, d in tables.items()],
    )
    assert_unique(long, [*on, "__set"])
    return long.groupBy(*on).agg(*[F.max(F.when(F.col("__set") == n, F.col("__v"))).alias(n) for n in tables])


def join_rate(left: DataFrame, right: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, rows with a partner, and their share."""
    hit = left.join(right.select(*on).distinct().withColumn("__hit", F.lit(1)), on, "left")
    return hit.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("__hit").alias("n_matched"),
        (F.count("__hit") / F.count(F.lit(1))).alias("match_rate"),
    )


def drop_bad_windows(labels: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    return labels.join(bad.select(*on).distinct(), on, "left_anti")


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], t: str, payload: list[str],
                 tolerance: float | None = None, tie: str | None = None) -> DataFrame:
    """For each left row the right row nearest in time.

    Adds `near_t`, `near_error` (left - right) and the payload columns, all
    null where nothing lies within the tolerance. Of two equally near the
    earlier wins; of rights at one time the lowest `tie`. Both sides become one
    ordered series and each left row looks once back and once ahead, so no
    pairs are built.
    """
    tie = tie or payload[0]
    pay = F.struct(F.col(t).alias("near_t"), *[F.col(p) for p in payload])
    rights = right.groupBy(*by, t).agg(F.min_by(pay, F.col(tie)).alias("__pay"))
    lefts = left.withColumn("__row", F.struct(*left.columns))
    both = lefts.select(*by, F.col(t).alias("__t"), F.lit(1).alias("__side"), "__row").unionByName(
        rights.select(*by, F.col(t).alias("__t"), F.lit(0).alias("__side"), "__pay"), allowMissingColumns=True
    )
    seen = scan(
        cut(both, by, ["__t", "__side"]), last={"__prev": F.col("__pay")}, first_from={"__next": F.col("__pay")}
    ).filter("__side = 1")
    back = F.col("__t") - F.col("__prev.near_t")
    ahead = F.col("__next.near_t") - F.col("__t")
    pick = F.when(back.isNull() | (ahead < back), F.col("__next")).otherwise(F.col("__prev"))
    if tolerance is not None:
        pick = F.when(F.least(back, ahead) <= tolerance, pick)
    return seen.withColumn("__pick", pick).select(
        "__row.*", "__pick.near_t", (F.col("__t") - F.col("__pick.near_t")).alias("near_error"),
        *[F.col(f"__pick.{p}").alias(f"near_{p}") for p in payload],
    )


def nearest_other(df: DataFrame, keys: list[str], cls: str, classes: tuple[str, str], t: str, tie: str,
                  tolerance: float) -> DataFrame:
    """Nearest event of the other of two classes, and whether it co-occurs."""
    a, b = classes
    at = {n: F.when(F.col(cls) == c, F.col(t)) for n, c in (("__a", a), ("__b", b))}
    df = scan(
        cut(df, keys, [t, tie]),
        last={f"{n}0": c for n, c in at.items()},
        first_from={f"{n}1": c for n, c in at.items()},
    )
    prev = F.when(F.col(cls) == a, F.col("__b0")).when(F.col(cls) == b, F.col("__a0"))
    nxt = F.when(F.col(cls) == a, F.col("__b1")).when(F.col(cls) == b, F.col("__a1"))
    now = F.col(t)
    pick = F.when(prev.isNull() | (nxt - now < now - prev), nxt).otherwise(prev)
    return (
        df.withColumn("other_t", pick)
        .withColumn("other_dt", F.col("other_t") - now)
        .withColumn("cooccurs", F.coalesce(F.abs("other_dt") <= tolerance, F.lit(False)))
        .drop("__a0", "__a1", "__b0", "__b1")
    )


def snap_to_samples(events: DataFrame, samples: DataFrame, by: list[str], t: str, idx: str) -> DataFrame:
    """Index of the sample nearest each event."""
    return nearest_join(events, samples.select(*by, t, idx), by, t, [idx])


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str],
                 b_id: str, flag: Column | None = None) -> DataFrame:
    """Per b interval: seconds covered by (flagged) a intervals, 0 if none.

    The seconds covered before a time x are x * N(x) - S(x), where N counts the
    a intervals open at x and S adds their starts and takes off the ends gone
    by. One ordered pass gives both at each end of every b interval, so no
    pairs of intervals are formed. Times are held in whole microseconds: the
    sums are exact.
    """
    def micros(c: Column) -> Column:
        return F.round(c * 1_000_000).cast("decimal(18,0)")

    left = a.filter(flag) if flag is not None else a
    edges = left.select(*by, F.explode(F.array(
        F.struct(micros(F.col(a_span[0])).alias("__x"), F.lit(1).alias("__d")),
        F.struct(micros(F.col(a_span[1])).alias("__x"), F.lit(-1).alias("__d")),
    )).alias("__p")).select(*by, "__p.*").withColumn("__side", F.lit(0))
    probes = b.select(*by, b_id, F.explode(F.array(
        F.struct(micros(F.col(b_span[0])).alias("__x"), F.lit(1).alias("__side")),
        F.struct(micros(F.col(b_span[1])).alias("__x"), F.lit(2).alias("__side")),
    )).alias("__p")).select(*by, b_id, "__p.*").withColumn("__d", F.lit(0))
    both = edges.unionByName(probes, allowMissingColumns=True)
    c = cut(both, by, ["__x", "__side"])
    run = scan(c, total={"__open": F.col("__d").cast("long"), "__sum": F.col("__d") * F.col("__x")}).filter("__side > 0")
    covered = F.col("__x") * F.col("__open").cast("decimal(18,0)") - F.col("__sum")
    sums = run.withColumn("__c", covered).groupBy(*by, b_id).agg(
        ((F.max(F.when(F.col("__side") == 2, F.col("__c"))) - F.max(F.when(F.col("__side") == 1, F.col("__c")))).cast("double") / 1e6).alias("overlap_sec")
    )
    return b.join(sums, [*by, b_id], "left")


def events_in_windows(events: DataFrame, t: str, size: float, step: float, n_windows: Column) -> DataFrame:
    """Each event once per window [k*step, k*step + size) holding it. The
    windows follow from arithmetic; no join."""
    hi = F.least(F.floor(F.col(t) / step), n_windows - 1)
    lo = F.greatest(F.floor((F.col(t) - size) / step) + 1, F.lit(0))
    return events.withColumn("window_idx", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))


def match_responses(targets: DataFrame, responses: DataFrame, by: list[str], t: str, id_: str, window: float,
                    rows: int | None = None) -> DataFrame:
    """One-to-one: in time order each target takes its first unused response
    within the window, both ends included.

    Seen from the responses this is a queue: each goes to the oldest target still
    waiting. Targets leave the queue in their order, so its state is one number,
    the targets used or expired so far: at a response it is raised to the
    expired ones, then by one if a target has come. Less the number of responses
    it is only ever clamped, which composes (`clamped`): nothing else crosses
    from piece to piece, and no queue is carried.
    """
    at, who = F.col(t).cast("double"), F.col(id_).alias("__id")

    def marks(df: DataFrame, time: Column, side: int) -> DataFrame:
        return df.where(F.col(t).isNotNull()).select(*by, time.alias("__t"), F.lit(side).alias("__side"), who)

    # At the same time a target comes before a response, and expires after it.
    both = marks(targets, at, 0).unionByName(marks(responses, at, 1)).unionByName(marks(targets, at + window, 2))

    def of(side: int) -> Column:
        return F.when(F.col("__side") == side, 1).otherwise(0).cast("long")

    seen = settle(scan(cut(both, by, ["__t", "__side", "__id"], rows), total={"__come": of(0), "__k": of(1), "__over": of(2)}).where("__side < 2"), "queue")
    k = F.col("__k")
    queue = clamped(seen.where("__side = 1").withColumn("__i", k - 1), by, "__i", F.col("__over") - (k - 1), F.col("__come") - k, "__y", "__y0", rows=rows)
    used = F.greatest(F.col("__y0") + k - 1, "__over")
    hits = queue.where(F.col("__y") + k == used + 1).select(*by, (used + 1).alias("__come"), F.col("__id").alias("response_id"), F.col("__t").alias("response_t"))
    hits = seen.where("__side = 0").select(*by, "__come", F.col("__id").alias(id_)).join(hits, [*by, "__come"]).drop("__come")
    return targets.join(hits, [*by, id_], "left").withColumn("latency", F.col("response_t") - F.col(t)).withColumn(
        "hit", F.col("response_t").isNotNull()
    )


def _window_hits(probes: DataFrame, marks: DataFrame, by: list[str], t: str, id_: str, lo: float, hi: float) -> DataFrame:
    """Per probe: number of marks in [t + lo, t + hi] and the first of them,
    from running counts at both ends."""
    ends = probes.select(
        *by, id_,
        F.explode(F.array(
            F.struct((F.col(t) + lo).alias("__t"), F.lit(0).alias("__side")),
            F.struct((F.col(t) + hi).alias("__t"), F.lit(2).alias("__side")),
        )).alias("__e"),
    ).select(*by, id_, "__e.*")
    both = ends.unionByName(
        marks.select(*by, F.col(t).alias("__t"), F.lit(1).alias("__side")), allowMissingColumns=True
    )
    is_mark = F.col("__side") == 1
    seen = scan(
        cut(both, by, ["__t", "__side"]),
        total={"__count": F.when(is_mark, 1).otherwise(0).cast("long")},
        first_from={"__first": F.when(is_mark, F.col("__t"))},
    ).filter(~is_mark)
    low = F.col("__side") == 0
    return seen.groupBy(*by, id_).agg(
        (F.max(F.when(~low, F.col("__count"))) - F.max(F.when(low, F.col("__count")))).alias("n_hits"),
        F.max(F.when(low, F.col("__first"))).alias("__first"),
    ).select(*by, id_, "n_hits", F.when(F.col("n_hits") > 0, F.col("__first")).alias("first_t"))


def _hit_lists(probes: DataFrame, marks: DataFrame, by: list[str], t: str, id_: str, lo: float, hi: float,
               cols: dict[str, Column]) -> DataFrame:
    """Per probe: the marks inside its window as '; '-joined text, in order.
    The pairs met are the ones the output lists, met by bucket of time."""
    width = hi - lo
    first = F.floor((F.col(t) + lo) / width)
    p = probes.select(*by, id_, F.col(t).alias("__t"), F.explode(F.sequence(first, F.floor((F.col(t) + hi) / width))).alias("__b"))
    m = marks.select(*by, F.col(t).alias("__m"), F.col(id_).alias("__mid"), F.floor(F.col(t) / width).alias("__b"))
    met = p.join(m, [*by, "__b"]).filter((F.col("__m") >= F.col("__t") + lo) & (F.col("__m") <= F.col("__t") + hi))
    hits = met.groupBy(*by, id_).agg(
        F.array_sort(F.collect_list(F.struct("__m", "__mid", *[c.alias(n) for n, c in cols.items()]))).alias("__hits")
    )
    return hits.select(*by, id_, *[F.array_join(F.col("__hits").getField(n), "; ").alias(n) for n in cols])


def response_table(targets: DataFrame, responses: DataFrame, by: list[str], t: str, id_: str, window: float) -> DataFrame:
    """Non-exclusive view per target: hit, first response, count and list."""
    found = _window_hits(targets, responses, by, t, id_, 0.0, window)
    lists = _hit_lists(targets, responses, by, t, id_, 0.0, window,
                       {"response_times": F.format_string("%.6f", F.col("__m"))})
    return (
        targets.join(found, [*by, id_]).join(lists, [*by, id_], "left")
        .withColumn("hit", F.col("n_hits") > 0)
        .withColumn("latency", F.col("first_t") - F.col(t))
        .fillna("", ["response_times"])
    )


def response_class(responses: DataFrame, targets: DataFrame, by: list[str], t: str, id_: str, window: float) -> DataFrame:
    """The reverse view per response: targets it could answer."""
    found = _window_hits(responses, targets, by, t, id_, -window, 0.0).drop("first_t")
    lists = _hit_lists(responses, targets, by, t, id_, -window, 0.0, {
        "target_ids": F.col("__mid").cast("string"),
        "latencies": F.format_string("%.6f", F.col("__t") - F.col("__m")),
    })
    return (
        responses.join(found, [*by, id_]).join(lists, [*by, id_], "left")
        .withColumn("after_target", F.col("n_hits") > 0).fillna("", ["target_ids", "latencies"])
    )


def join_fallback(df: DataFrame, dim: DataFrame, tries: list[dict[str, Column]], values: list[str]) -> DataFrame:
    """Several keys tried in order; the first hit supplies the whole record.
    Each try maps the dimension's key columns to expressions over df."""
    keys = list(tries[0])
    record = dim.groupBy(*keys).agg(F.min(F.struct(*values)).alias("__rec"))
    out = df
    for i, key in enumerate(tries):
        named = record.select(*[F.col(k).alias(f"__k{i}_{k}") for k in keys], F.col("__rec").alias(f"__rec{i}"))
        out = out.withColumns({f"__x{i}_{k}": c for k, c in key.items()})
        cond = reduce(lambda a, b: a & b, [F.col(f"__x{i}_{k}") == F.col(f"__k{i}_{k}") for k in keys])
        out = out.join(named, cond, "left").drop(*[f"__k{i}_{k}" for k in keys], *[f"__x{i}_{k}" for k in keys])
    pick = F.coalesce(*[F.col(f"__rec{i}") for i in range(len(tries))])
    return out.withColumn("__rec", pick).select(*df.columns, "__rec.*")


def source_score(name: Column, run: Column, session: Column, video: Column) -> Column:
    """4 for the run, 2 for the session, 1 for the video named in a file; the
    number may lack its leading zero."""
    low = F.lower(name)

    def has(text: Column, pad: str) -> Column:
        text = F.lower(text)
        return low.contains(text) | low.contains(F.regexp_replace(text, f"{pad}-0", f"{pad}-"))

    return (
        F.when(has(run, "run"), 4).otherwise(0)
        + F.when(has(session, "ses"), 2).otherwise(0)
        + F.when(low.contains(F.lower(video)), 1).otherwise(0)
    )


def pick_best(df: DataFrame, keys: list[str], score: Column, item: str, unique: bool = True) -> DataFrame:
    """The best-scoring item per key. A tie at the top yields null when the
    choice must be unique, otherwise the first by name. Partial aggregation
    does it; no group is ever sorted in one task."""
    top = df.groupBy(*keys).agg(F.max(score).alias("score"))
    best = df.withColumn("__s", score).join(top, keys).filter(F.col("__s") == F.col("score"))
    out = best.groupBy(*keys).agg(
        F.first("score").alias("score"), F.min(item).alias(item), F.count(F.lit(1)).alias("n_best")
    )
    return out.withColumn(item, F.when(F.col("n_best") == 1, F.col(item))) if unique else out


def pairs(df: DataFrame, by: list[str], entity: str, time: str, value: str) -> DataFrame:
    """Correlation of every pair of entities within `by`."""
    return pairwise_moments(df, by, entity, time, value).withColumn("r", moments_corr()).select(*by, "a", "b", F.col("n").cast("long").alias("n"), "r")


def join_bands(df: DataFrame, on: list[str], band: str, value: str, a: str, b: str) -> DataFrame:
    """Two bands side by side, windows having both."""
    sides = df.filter(F.col(band).isin(a, b)).groupBy(*on).agg(
        F.max(F.when(F.col(band) == a, F.col(value))).alias(a), F.max(F.when(F.col(band) == b, F.col(value))).alias(b)
    )
    return sides.dropna(subset=[a, b])


def newest(df: DataFrame, keys: list[str], item: str, mtime: str) -> DataFrame:
    """The most recently written item per key, '_updated' copies first."""
    rank = F.struct(F.col(item).contains("_updated"), F.col(mtime), F.col(item))
    return df.groupBy(*keys).agg(F.max_by(item, rank).alias(item))
