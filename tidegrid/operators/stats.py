"""Tests, corrections, correlations between subjects and channels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.digests import digits_48
from tidegrid.functions.scalars import hash_digits, unit_bits, unit_hash
from tidegrid.functions.special import p_two_sided_t, p_upper_chi2, p_upper_f
from tidegrid.operators.multivar import product_sums
from tidegrid.operators.group import average_rank, corr_of, with_row, with_stats
from tidegrid.operators.pairwise import moments_corr, pairwise_moments
from tidegrid.operators.scan import SEG, Cut, cut, pieces, scan
from tidegrid.operators.series import zscore
from tidegrid.session import settle


def ttest_1samp(df: DataFrame, by: list[str], col: str, min_n: int = 3) -> DataFrame:
    """t of the mean against 0, missing below min_n or without spread."""
    d = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    ok = (F.col("n") >= min_n) & (F.col("sd") > 0)
    return d.withColumn("t", F.when(ok, F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def with_t_p(df: DataFrame, dof: Column, t: str = "t") -> DataFrame:
    return df.withColumn("p", p_two_sided_t(F.col(t), dof))


def ttest_rel(df: DataFrame, by: list[str], a: str, b: str, min_n: int = 2) -> DataFrame:
    return ttest_1samp(df.withColumn("__d", F.col(a) - F.col(b)), by, "__d", min_n)


def ttest_ind(df: DataFrame, by: list[str], col: str, side: Column, equal_var: bool = True) -> DataFrame:
    """Two samples: rows where side is true against those where it is false."""
    a, b = F.when(side, F.col(col)), F.when(~side, F.col(col))
    d = df.groupBy(*by).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("__va"), F.var_samp(b).alias("__vb"),
    )
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("__va"), F.col("__vb")
    if equal_var:
        dof = (na + nb - 2).cast("double")
        se = F.sqrt(((na - 1) * va + (nb - 1) * vb) / dof * (1 / na + 1 / nb))
    else:
        se = F.sqrt(va / na + vb / nb)
        dof = F.pow(va / na + vb / nb, 2) / (F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1))
    return d.withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.when(se > 0, se)).withColumn("dof", dof).drop("__va", "__vb")


def adjust(df: DataFrame, by: list[str], p: str, tie: str, method: str = "fdr_bh", out: str = "p_adj", rows: int | None = None) -> DataFrame:
    """Corrected p over the non-missing tests of each family; `tie` orders equal
    ones and is unique in a family. Ranks and the running minimum from the
    largest p down go piece by piece, so a family may hold all rows."""
    there = df.filter(F.col(p).isNotNull())
    d = with_stats(there, by, {"__m": F.count(F.lit(1))})
    if method == "bonferroni":
        d = d.withColumn(out, F.least(F.col(p) * F.col("__m"), F.lit(1.0))).drop("__m")
    else:
        family = by or ["__all"]
        d = d if by else d.withColumn("__all", F.lit(0))
        # One cut serves both directions: ranks first, then minima on the same pieces.
        c = cut(d, family, [p, tie], rows)
        ranked = scan(Cut(c.df.withColumn("__piece", F.col(SEG)), family, [p, tie], c.single), total={"__rank": F.lit(1).cast("long")})
        ranked = ranked.withColumnRenamed("__piece", SEG)
        raw = F.col(p) * F.col("__m") / F.col("__rank")
        d = scan(Cut(ranked, family, [p, tie], c.single), least_from={out: raw}).withColumn(out, F.least(out, F.lit(1.0))).drop("__m", "__rank", "__all")
    missing = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return d.select(*missing.columns).unionAll(missing)


#: Rows of a task's result that wait to be handed on.
PENDING = 1 << 18


def _cells(n_perm: int, seed: int):
    """For each permutation the rows (__g, __id, __v, __tail, __lo, __hi) hashed: per
    group one row of those below __lo, and each one up to __hi with its hash."""
    heads = [f"{seed}-{p}".encode() for p in range(1, n_perm + 1)]
    room = 55 - max(map(len, heads), default=0)  # with one block

    def run(batches):
        out, waiting = [], 0
        for table, tails, width in (x for batch in batches if batch.num_rows for x in _by_width(batch, room)):
            v, there = table.column("__v").to_numpy(zero_copy_only=False), table.column("__v").is_valid().to_numpy(zero_copy_only=False)
            lo, hi = (table.column(x).to_numpy() for x in ("__lo", "__hi"))
            groups, code = np.unique(table.column("__g").to_numpy(), return_inverse=True)
            known, k = np.where(there, v, 0.0), len(groups)
            for p, cell in enumerate(digits_48(heads, tails, width), 1):
                below = cell < lo
                at = np.flatnonzero((cell <= hi) & ~below)
                own = code[below]
                n = np.bincount(own, minlength=k)
                some = np.flatnonzero(n)
                sums, count = (np.bincount(own, weights=w, minlength=k)[some] for w in (known[below], there[below]))
                size = len(some) + len(at)
                out.append(pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([groups[some], groups[code[at]]])), pa.array(np.full(size, p, dtype=np.int32)),
                    pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), cell[at]]), mask=np.arange(size) < len(some)),
                    pa.concat_arrays([pa.nulls(len(some), table.column("__id").type), table.column("__id").take(pa.array(at))]),
                    pa.array(np.concatenate([n[some], np.ones(len(at), dtype=np.int64)])), pa.array(np.concatenate([sums, known[at]])),
                    pa.array(np.concatenate([count.astype(np.int64), there[at].astype(np.int64)]))], names=["__g", "perm", "__cell", "__id", "__c", "__s", "__k"]))
                waiting += size
                if waiting > PENDING:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, waiting = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _by_width(batch: pa.RecordBatch, room: int):
    """The rows with __tail of up to `room` bytes at once, longer ones by their
    length, with those bytes as a matrix and their number."""
    tail = batch.column("__tail").cast(pa.large_binary())
    width = pc.binary_length(tail).to_numpy().astype(np.int64)
    kinds = np.where(width <= room, 0, width)
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        w = width[at]
        text = np.zeros((len(at), int(w.max())), dtype=np.uint8)
        text[np.arange(text.shape[1]) < w[:, None]] = np.frombuffer(b"".join(tail.take(pa.array(at)).to_pylist()), dtype=np.uint8)
        yield batch.take(pa.array(at)), text, w


def permutation_test(df: DataFrame, by: list[str], value: str, side: Column, id_: str, n_perm: int, seed: int) -> DataFrame:
    """Mean difference of pooled values against random splits of the same
    sizes: empirical two-sided p with one added to both counts.

    In each permutation the n_a rows of smallest hash of (seed, permutation, id)
    form side a. The n_a-th smallest of n uniform hashes lies close to n_a / n,
    so in the scan rows well below it are summed, rows well above it dropped,
    and only the rows between, some sqrt(n), are put in order. Rows are hashed
    per permutation inside the task only, a batch at a time in numpy; a counter per permutation and those
    few rows leave it. Where the bracket misses (ids that repeat a lot), the
    permutation is done again over all its rows. Without rows on both sides
    `observed` and p are null. `by` names one column at least."""
    d = df.withColumn("__a", side).select(*by, id_, F.col(value).cast("double").alias("__v"), "__a")
    a = F.col("__a")
    share, n = F.col("__na") / F.col("__n"), F.col("__n")
    reach = 8 * F.sqrt(share * (1 - share) / n) + 64 / n
    obs = d.groupBy(*by).agg(
        (F.avg(F.when(a, F.col("__v"))) - F.avg(F.when(~a, F.col("__v")))).alias("observed"), F.count_if(a).alias("__na"), F.count(F.lit(1)).alias("__n"),
        F.sum("__v").alias("__sum"), F.count("__v").alias("__there"))
    obs = settle(obs.withColumns({
        "__g": F.monotonically_increasing_id(), "__lo": unit_bits(F.greatest(share - reach, F.lit(0.0))), "__hi": unit_bits(F.least(share + reach, F.lit(1.0)))}), "observed")
    keys = ["__g", "perm"]

    def split(cells: DataFrame) -> DataFrame:
        cells = cells.groupBy(*keys, "__cell", "__id").agg(F.sum("__c").alias("__c"), F.sum("__s").alias("__s"), F.sum("__k").alias("__k")).join(obs.select("__g", "__na"), "__g")
        upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__cell").asc_nulls_first(), F.col("__id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        first = F.least(F.col("__c"), F.col("__na") - F.col("__upto") + F.col("__c"))  # of the cell's rows, how many belong to side a
        part = F.when(first > 0, first / F.col("__c")).otherwise(0.0)
        return cells.withColumn("__upto", upto).groupBy(*keys).agg(
            F.sum(part * F.col("__s")).alias("__sa"), F.sum(part * F.col("__k")).alias("__ka"),
            # The bracket holds the rank: it is not inside the rows summed as one, nor beyond the last one seen.
            ((F.max("__upto") >= F.max("__na")) & (F.coalesce(F.max(F.when(F.col("__cell").isNull(), F.col("__c"))), F.lit(0)) <= F.max("__na"))).alias("__met"))

    rows = d.select(*by, F.col(id_).alias("__id"), "__v").join(obs.select(*by, "__g", "__lo", "__hi"), by).drop(*by)
    # The work is n_perm times the rows: dealt out evenly, whatever files they come from.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # As concat_ws does, without a dash where there is no id.
    tail = F.coalesce(F.concat(F.lit("-"), F.col("__id").cast("string")), F.lit("")).cast("binary").alias("__tail")
    kind = d.schema[id_].dataType.simpleString()
    null = settle(split(rows.select("*", tail).mapInArrow(_cells(n_perm, seed), f"__g long, perm int, __cell long, __id {kind}, __c long, __s double, __k long")), "null")
    if not null.where("not __met").isEmpty():
        again = null.where("not __met").select(*keys)
        cell = F.conv(hash_digits(F.lit(seed), F.col("perm"), F.col("__id")), 16, 10).cast("long").alias("__cell")
        whole = rows.join(again, "__g").select(*keys, cell, "__id", F.lit(1).cast("long").alias("__c"), F.col("__v").alias("__s"), F.col("__v").isNotNull().cast("long").alias("__k"))
        null = null.where("__met").unionAll(split(whole))
    null = null.join(obs, "__g")
    sb, kb = F.col("__sum") - F.col("__sa"), F.col("__there") - F.col("__ka")
    null = null.withColumn("diff", F.col("__sa") / F.when(F.col("__ka") > 0, F.col("__ka")) - sb / F.when(kb > 0, kb))
    hits = F.count_if(F.abs("diff") >= F.abs("observed"))
    null = null.groupBy(*by).agg(hits.alias("n_extreme"))
    extreme = F.coalesce("n_extreme", F.lit(0)).cast("long")
    p = F.when(F.col("observed").isNotNull(), (extreme + 1) / F.lit(n_perm + 1.0))
    return obs.join(null, by, "left").select(*by, "observed", extreme.alias("n_extreme"), p.alias("p"))


def _between(df: DataFrame, group: list[str], col: str, by: list[str]) -> DataFrame:
    """Mean squares between and within groups, from group moments."""
    g = df.filter(F.col(col).isNotNull()).groupBy(*by, *group).agg(
        F.count(col).alias("__n"), F.avg(col).alias("__m"), F.coalesce(F.var_pop(col), F.lit(0.0)).alias("__v")
    )
    total = with_stats(g, by, {"__gm": F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")})
    dev = F.col("__m") - F.col("__gm")
    s = total.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("__n").alias("n_obs"),
        F.sum(F.col("__n") * dev * dev).alias("__ssb"), F.sum(F.col("__n") * F.col("__v")).alias("__ssw"),
    )
    k, n = F.col("n_groups"), F.col("n_obs")
    return s.select(*by, "n_groups", "n_obs", (F.col("__ssb") / (k - 1)).alias("ms_between"), (F.col("__ssw") / (n - k)).alias("ms_within"))


def anova_1way(df: DataFrame, group: list[str], col: str, by: list[str] | None = None) -> DataFrame:
    d = _between(df, group, col, by or [])
    return d.withColumn("f", F.col("ms_between") / F.col("ms_within"))


def with_f_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", p_upper_f(F.col("f"), F.col("n_groups") - 1, F.col("n_obs") - F.col("n_groups")))


def kruskal(df: DataFrame, group: str, col: str) -> DataFrame:
    """H from average ranks, with the tie correction."""
    d = average_rank(df.filter(F.col(col).isNotNull()).select(group, col), [], col, "__r")
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.sum("__r").alias("__s"))
    h = g.agg(F.sum("__n").alias("n_obs"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("__s") * F.col("__s") / F.col("__n")).alias("__q"))
    ties = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("__c")).agg(
        F.sum(F.col("__c") * F.col("__c") * F.col("__c") - F.col("__c")).alias("__t")
    )
    n = F.col("n_obs").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("__q") - 3 * (n + 1)
    return with_row(h, ties).select("n_groups", "n_obs", (raw / (1 - F.col("__t") / (n * n * n - n))).alias("h"))


def with_chi2_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", p_upper_chi2(F.col("h"), F.col("n_groups") - 1))


def icc1(df: DataFrame, group: list[str], col: str, by: list[str] | None = None) -> DataFrame:
    """One-way random intraclass correlation; k is the mean group size."""
    d = _between(df, group, col, by or []).withColumn("k_avg", F.col("n_obs") / F.col("n_groups"))
    b, w = F.col("ms_between"), F.col("ms_within")
    return d.withColumn("icc", (b - w) / (b + (F.col("k_avg") - 1) * w))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of every two features over the rows that have both, long;
    missing where a feature doesn't vary."""
    mean = np.array([m if m is not None else 0.0 for m in df.agg(*[F.avg(c) for c in cols]).first()])
    n, s, q, p = product_sums(df, cols, mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        r = (p - s * s.T / n) / np.sqrt(spread * spread.T)
    rows = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def corr_by(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*by).agg(corr_of(a, b).alias("r"))


def corr_of_means(df: DataFrame, by: list[str], time: str, a: str, b: str) -> DataFrame:
    """Correlation of two group-mean timecourses."""
    means = df.groupBy(*by, time).agg(F.avg(a).alias("__a"), F.avg(b).alias("__b"))
    return means.groupBy(*by).agg(corr_of("__a", "__b").alias("r"))


def complete_times(df: DataFrame, by: list[str], entity: str, time: str, cols: list[str]) -> DataFrame:
    """Rows at times where every entity of the group has every column."""
    d = df.dropna(subset=cols)
    n = df.select(*by, entity).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__all")) if by else \
        df.select(entity).distinct().agg(F.count(F.lit(1)).alias("__all"))
    at = d.groupBy(*by, time).agg(F.count(F.lit(1)).alias("__here"))
    at = at.join(n, by) if by else with_row(at, n)
    return d.join(at.filter("__here = __all").select(*by, time), [*by, time], "left_semi")


def isc(df: DataFrame, entity: str, time: str, cols: list[str], by: list[str] | None = None, include_self: bool = False) -> DataFrame:
    """Each entity's mean correlation with all others, averaged over columns.

    With every series scaled to mean 0 and sd 1, the sum of an entity's
    correlations is the mean over time of its value times the sum of the
    others' values. That sum is one aggregate per time, so no pairs of
    entities are formed. Needs complete times (see complete_times).
    """
    by = by or []
    z = zscore(df, [*by, entity], cols, 0)
    z = with_stats(z, [*by, time], {f"__s_{c}": F.sum(f"{c}_z") for c in cols})
    terms = [F.avg(F.col(f"{c}_z") * (F.col(f"__s_{c}") - F.col(f"{c}_z"))) for c in cols]
    per = z.groupBy(*by, entity).agg((reduce(lambda a, b: a + b, terms) / len(cols)).alias("__sum"), F.count(F.lit(1)).alias("n_times"))
    n = per.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    per = per.join(n, by) if by else with_row(per, n)
    r = (F.col("__sum") + 1) / F.col("__n") if include_self else F.col("__sum") / (F.col("__n") - 1)
    return per.select(*by, entity, "n_times", r.alias("isc"))


def windowed_isc(windowed: DataFrame, entity: str, time: str, cols: list[str], size: int, include_self: bool = True) -> DataFrame:
    """isc within each complete window (rows from assign_windows)."""
    full = windowed.groupBy(entity, "window_idx").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size)
    d = windowed.join(full.select(entity, "window_idx"), [entity, "window_idx"], "left_semi")
    return isc(d, entity, time, cols, ["window_idx"], include_self)


def shift_of(entity: Column, perm: Column, n: Column, seed: int) -> Column:
    return F.floor(unit_hash(F.lit(seed), entity, perm) * n)


#: Entities whose series meet in a task, and bytes of group sums that do.
CHUNK, SUM_BYTES = 256, 1 << 25


def isc_null(df: DataFrame, entity: str, time: str, cols: list[str], n_perm: int, seed: int) -> DataFrame:
    """isc after turning every series by its own random number of samples,
    n_perm times. `time` is a 0-based index, on a grid that all entities share:
    a series on it is one cell.

    Turning changes neither mean nor spread, so series are scaled once. A task
    adds up the turned series that it holds and hands on one sum per permutation,
    never a turned copy; then chunks of entities meet blocks of the whole sums
    and take their products. What is shuffled grows with times x permutations
    for each chunk of entities, not with rows x permutations."""
    z = zscore(df.select(entity, time, *cols), [entity], cols, 0)
    n_all, grid = z.agg(F.countDistinct(entity), F.max(time) + 1).first()
    if not n_all:
        return df.select(F.lit(0).alias("perm"), entity, F.lit(0).cast("long").alias("n_times"), F.lit(0.0).alias("isc")).where("false")
    kind, c = dict(df.dtypes)[entity], len(cols)
    rows = z.select(entity, F.col(time).cast("long").alias("__t"), *[F.col(f"{x}_z").alias(f"__z{i}") for i, x in enumerate(cols)])

    def pack(batches):
        for table, starts in pieces(batches, [entity]):
            t, v = table.column("__t").to_numpy(), [table.column(f"__z{i}").to_numpy() for i in range(c)]
            blobs, size, present = [], [], []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                m = np.full((c, int(t[s:e].max()) + 1), np.nan)
                for i in range(c):
                    m[i, t[s:e]] = v[i][s:e]
                blobs.append(m.tobytes()), size.append(m.shape[1]), present.append(int(e - s))
            heads = table.take(pa.array(starts)).select([entity])
            for name, col in (("__n", pa.array(size, pa.int64())), ("n_times", pa.array(present, pa.int64())), ("__z", pa.array(blobs, pa.binary()))):
                heads = heads.append_column(name, col)
            yield from heads.to_batches()

    series = rows.repartition(entity).sortWithinPartitions(entity, "__t").mapInArrow(pack, f"`{entity}` {kind}, __n long, n_times long, __z binary")
    chunks = -(-n_all // CHUNK)
    turns = F.transform(F.sequence(F.lit(1), F.lit(n_perm)), lambda p: shift_of(F.col(entity), p, F.col("__n"), seed))
    series = settle(series.withColumns({"__k": turns, "__chunk": F.pmod(F.xxhash64(entity), F.lit(chunks)).cast("int")}), "series")

    def load(table):
        n = table.column("__n").to_numpy()
        z = [np.frombuffer(b.as_py()).reshape(c, -1) for b in table.column("__z")]
        k = table.column("__k").combine_chunks() if isinstance(table, pa.Table) else table.column("__k")
        k = k.chunk(0) if isinstance(k, pa.ChunkedArray) else k
        return n, z, k.flatten().to_numpy().reshape(len(n), n_perm)

    def add(batches):
        for batch in batches:
            n, z, k = load(batch)
            full = [np.nan_to_num(m) for m in z]
            for p in range(n_perm) if len(n) else ():
                total = np.zeros((c, grid))
                for e, m in enumerate(full):
                    total[:, : n[e]] += np.roll(m, -k[e, p], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([p + 1], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["perm", "s"])

    def total(table):
        out = np.zeros(c * grid)
        for b in table.column("s"):
            out += np.frombuffer(b.as_py())
        return pa.table({"perm": table.column("perm").slice(0, 1), "s": pa.array([out.tobytes()], pa.binary())})

    sums = settle(series.select("__n", "__z", "__k").mapInArrow(add, "perm int, s binary").groupBy("perm").applyInArrow(total, "perm int, s binary"), "sums")
    block = max(1, SUM_BYTES // (8 * c * grid))
    blocks = -(-n_perm // block)
    left = series.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = sums.withColumn("__block", F.floor((F.col("perm") - 1) / block).cast("int")).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def products(own, whole):
        n, z, k = load(own)
        full, there = [np.nan_to_num(m) for m in z], [np.isfinite(m).sum(axis=1) for m in z]
        square = [(m * m).sum(axis=1) for m in full]
        perm = whole.column("perm").to_numpy()
        out = np.full((len(perm), len(n)), np.nan)
        for i, b in enumerate(whole.column("s")):
            s = np.frombuffer(b.as_py()).reshape(c, grid)
            for e, m in enumerate(full):
                both = (m * np.roll(s[:, : n[e]], k[e, perm[i] - 1], axis=1)).sum(axis=1) - square[e]
                if there[e].all() and n_all > 1:
                    out[i, e] = (both / there[e]).mean() / (n_all - 1)
        rows = own.take(pa.array(np.tile(np.arange(len(n)), len(perm)))).select([entity, "n_times"])
        rows = rows.add_column(0, "perm", pa.array(np.repeat(perm, len(n)), pa.int32()))
        return rows.append_column("isc", pa.array(out.ravel(), from_pandas=True))

    by = ["__chunk", "__block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        lambda own, whole: products(own, whole) if own.num_rows else pa.table({"perm": pa.array([], pa.int32()), entity: own.column(entity), "n_times": own.column("n_times"), "isc": pa.array([], pa.float64())}),
        f"perm int, `{entity}` {kind}, n_times long, isc double")


def mean_pairwise_corr(df: DataFrame, entity: str, time: str, col: str, by: list[str] | None = None) -> DataFrame:
    """Mean correlation over all pairs, complete times only."""
    by = by or []
    per = isc(complete_times(df, by, entity, time, [col]), entity, time, [col], by)
    return per.groupBy(*by).agg(F.avg("isc").alias("mean_r"), F.count(F.lit(1)).alias("n_entities"))


def intersubject_variability(df: DataFrame, entity: str, time: str, col: str) -> tuple[DataFrame, DataFrame]:
    """Per time: sd and mean absolute deviation over subjects; and the mean
    pairwise correlation of the group-demeaned series."""
    d = with_stats(df, [time], {"__m": F.avg(col)}).withColumn("demeaned", F.col(col) - F.col("__m"))
    spread = d.groupBy(time).agg(F.stddev_samp("demeaned").alias("sd"), F.avg(F.abs("demeaned")).alias("mad"))
    return spread, mean_pairwise_corr(d, entity, time, "demeaned")


def band_coupling(both: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return both.groupBy(*keys).agg(corr_of(a, b).alias("r"), F.count(F.lit(1)).alias("n_windows"))


def coupling_by_region(coupling: DataFrame, by: list[str]) -> DataFrame:
    return coupling.groupBy(*by).agg(F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"), F.count("r").alias("n_elec"))


def windowed_fc(windowed: DataFrame, by: list[str], channel: str, time: str, value: str) -> DataFrame:
    """Channel correlations within each window."""
    return pairwise_moments(windowed, [*by, "window_idx"], channel, time, value).withColumn("r", moments_corr()).select(
        *by, "window_idx", "a", "b", F.col("n").cast("long").alias("n"), "r")


def state_fc(power: DataFrame, by: list[str], state: str, channel: str, time: str, value: str) -> DataFrame:
    """Channel correlations within each state of more than one window."""
    m = pairwise_moments(power.filter(F.col(state).isNotNull()), [*by, state], channel, time, value)
    return m.filter("n > 1").withColumn("r", moments_corr()).select(*by, state, "a", "b", F.col("n").cast("long").alias("n"), "r")


def region_fc(power: DataFrame, by: list[str], region: str, channel: str, time: str, value: str, include_diag: bool = True) -> DataFrame:
    """Mean channel correlation of every region pair, without channel pairs.

    Scaled channel series are summed per region and time; the product of two
    regions' sums, averaged over time, is the sum of their channels'
    correlations. Needs complete times per group. A region with itself counts
    each channel's 1 unless include_diag is off.
    """
    z = zscore(power, [*by, channel], [value], 0).filter(F.col(f"{value}_z").isNotNull())
    size = z.select(*by, region, channel).distinct().groupBy(*by, region).agg(F.count(F.lit(1)).alias("n_channels"))
    sums = z.groupBy(*by, region, time).agg(F.sum(f"{value}_z").alias("__s"))
    off = pairwise_moments(sums, by, region, time, "__s", centre=False).select(*by, "a", "b", (F.col("sxy") / F.col("n")).alias("__t"))
    own = sums.groupBy(*by, region).agg(F.avg(F.col("__s") * F.col("__s")).alias("__t"))
    na = size.select(*by, F.col(region).alias("a"), F.col("n_channels").alias("__na"))
    nb = size.select(*by, F.col(region).alias("b"), F.col("n_channels").alias("__nb"))
    between = off.join(na, [*by, "a"]).join(nb, [*by, "b"]).select(
        *by, F.col("a").alias("region_a"), F.col("b").alias("region_b"), (F.col("__t") / (F.col("__na") * F.col("__nb"))).alias("r"))
    n = F.col("n_channels")
    inside = F.col("__t") / (n * n) if include_diag else F.when(n > 1, (F.col("__t") - n) / (n * (n - 1)))
    within = own.join(size, [*by, region]).select(*by, F.col(region).alias("region_a"), F.col(region).alias("region_b"), inside.alias("r"))
    return between.unionByName(within)


def group_fc(fc: DataFrame, state: str, internal: str, external: str) -> DataFrame:
    """Mean over subjects of each region pair per state, and the difference."""
    d = fc.groupBy("region_a", "region_b").agg(
        F.avg(F.when(F.col(state) == internal, F.col("r"))).alias("r_int"), F.avg(F.when(F.col(state) == external, F.col("r"))).alias("r_ext")
    )
    return d.withColumn("r_diff", F.col("r_int") - F.col("r_ext"))
