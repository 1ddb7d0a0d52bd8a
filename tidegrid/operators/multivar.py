"""Moments of several columns, components, low-rank splits.

Rows stay in Spark; only p x p numbers (p columns) reach the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.group import with_row, with_stats
from tidegrid.operators.pairwise import pairwise_moments
from tidegrid.session import settle


def product_sums(df: DataFrame, cols: list[str], mean: np.ndarray) -> np.ndarray:
    """Four p x p matrices over the rows where both columns are present: counts,
    sums of the first, sums of its squares, sums of products; values are taken
    less `mean`. Each task multiplies its batches and hands on one row per cell."""
    p = len(cols)

    def run(batches):
        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) - mean
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    got = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    out = np.zeros(4 * p * p)
    for cell, s in got.collect():
        out[cell] = s
    return out.reshape(4, p, p)


def moment_matrix(df: DataFrame, cols: list[str], centre: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance (or mean products when not
    centred) of complete rows. The first pass finds the means, the second sums
    products about them."""
    d = df.dropna(subset=cols)
    head = d.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    n, mean = head[0], np.array(head[1:], dtype=float)
    if n == 0:
        raise ValueError("no complete rows")
    return n, mean, product_sums(d, cols, mean if centre else np.zeros(len(cols)))[3] / n


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenvalues and vectors (columns); the largest loading of each is positive."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:k]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return w[order], v


def pca(df: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, pd.DataFrame]:
    """Scores PC1..PCk as columns, and a small table of loadings with each
    component's share of variance."""
    n, mean, cov = moment_matrix(df, cols)
    w, v = components(cov, k)
    out = df.withColumns({
        f"PC{j + 1}": sum(((F.col(c) - F.lit(float(m))) * F.lit(float(v[i, j])) for i, (c, m) in enumerate(zip(cols, mean))), F.lit(0.0))
        for j in range(k)
    })
    load = pd.DataFrame({"feature": cols, **{f"PC{j + 1}": v[:, j] for j in range(k)}})
    load.attrs["explained"] = (w / np.trace(cov)).tolist()
    return out, load


def loadings_table(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Loadings and explained share, long."""
    _, load = pca(df, cols, k)
    rows = [
        (f"PC{j + 1}", c, float(load[f"PC{j + 1}"][i]), float(load.attrs["explained"][j])) for j in range(k) for i, c in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, "component string, feature string, loading double, explained double")


#: Rounds of the split between two written states.
REPLAY = 8

#: Numbers in a block of the split's rows.
BLOCK = 1 << 16

#: Rounds after which a written state may be a combination of the last ones.
PLAIN = 500


def _cancelling(steps: np.ndarray) -> np.ndarray:
    """Weights of sum one under which steps cancel best, from their products."""
    w = np.linalg.solve(steps + 1e-10 * np.trace(steps) / len(steps) * np.eye(len(steps)), np.ones(len(steps)))
    return w / w.sum()


def robust_pca(df: DataFrame, id_: str, cols: list[str], lam: float | None = None, mu: float | None = None,
               iters: int = 1000, tol: float = 1e-7) -> DataFrame:
    """Split the feature matrix into low rank + sparse by alternating
    directions, until what both leave is below tol of the whole; an error if
    `iters` rounds don't get there. Returns id, <col>_low and <col>_sparse.

    Singular values are shrunk through the p x p Gram matrix: for A = U S V',
    the shrunk A is A V max(1 - tau/S, 0) V', a p x p map applied row by row.
    With t = m - low + y/mu the sparse part is t shrunk by lam/mu and y/mu is
    what that takes off, so t is all the state there is. A round is one job
    without a shuffle: a task applies the maps since the last written state to
    its rows and hands on its Gram matrix and what the last round left. State is
    written to the shared folder every REPLAY rounds, so a lost executor costs
    one round; it has a row per block of rows, whose numbers are handed on as
    they are.

    Rounds alone grow with the rows (411, 775 and over 1 106 for 2 000, 10 256
    and 51 282). A state that a round leaves as it is holds the same split by
    whatever way it is reached, so from round PLAIN on the state that is written
    is the combination of the last REPLAY ones whose steps cancel best (reduced
    rank extrapolation). That is done only where the last step is the shortest
    so far: after a bad one plain rounds, whose steps never grow, go on. The end
    is judged on a plain round in any case.
    """
    p = len(cols)
    base = df.dropna(subset=cols).select(id_, F.array(*[F.col(c).cast("double") for c in cols]).alias("m"))
    n, absum, sq = base.select(F.explode("m").alias("x")).agg(F.count(F.lit(1)), F.sum(F.abs("x")), F.sum(F.col("x") * F.col("x"))).first()
    mu = mu or n / (4.0 * absum)
    lam = lam or 1.0 / np.sqrt(max(n / p, p))
    reach = lam / mu
    id_type = dict(df.dtypes)[id_]
    blocked = f"ids array<{id_type}>, m binary, t binary"

    def block(ids, m, t):
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x.tobytes()], pa.binary()) for x in (m, t)]], names=["ids", "m", "t"])

    def blocks(batches):
        size = max(BLOCK // p, 1)
        for batch in batches:
            m = batch.column("m").flatten().to_numpy().reshape(-1, p)
            for i in range(0, len(m), size):
                yield block(batch.column(id_)[i:i + size], m[i:i + size], np.zeros_like(m[i:i + size]))

    # Dealt anew, as every round takes as long as its largest task.
    state = settle(base.repartition(id_).mapInArrow(blocks, blocked), "split")

    def replayed(batches, maps):
        """Per block: ids, m, and low and t after the maps, with t before and
        after each of them."""
        for batch in batches:
            for i in range(batch.num_rows):
                m, t = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, p) for c in ("m", "t"))
                low, states = np.zeros_like(m), [t]
                for shrink in maps:
                    y = np.clip(t, -reach, reach)
                    low = (m - (t - y) + y) @ shrink
                    t = m - low + y
                    states.append(t)
                yield batch.column("ids")[i].values, m, low, states

    def lists(x):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))

    def gram(maps):
        def run(batches):
            g, left, steps = np.zeros((p, p)), np.zeros(1), np.zeros((REPLAY, REPLAY))
            for _, m, low, states in replayed(batches, maps):
                t = states[-1]
                y = np.clip(t, -reach, reach)
                left += ((m - low - (t - y)) ** 2).sum()
                a = m - (t - y) + y
                g += a.T @ a
                if len(maps) == REPLAY:
                    f = np.diff(np.stack(states), axis=0).reshape(REPLAY, -1)
                    steps += f @ f.T
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left, g.ravel(), steps.ravel()]).tobytes()], pa.binary())], names=["g"])
        return run

    def write(maps, weights):
        def run(batches):
            for ids, m, _, states in replayed(batches, maps):
                t = sum(w * x for w, x in zip(weights, states[1:]) if w)
                yield block(ids, m, t)
        return run

    def parts(maps):
        def run(batches):
            for ids, _, low, states in replayed(batches, maps):
                t = states[-1]
                yield pa.RecordBatch.from_arrays([ids, lists(low), lists(t - np.clip(t, -reach, reach))], names=[id_, "low", "s"])
        return run

    def summed(maps):
        """What the last map left, the Gram matrix, and products of the maps' steps."""
        rows = state.select("m", "t", "ids").mapInArrow(gram(maps), "g binary").collect()
        cells = sum((np.frombuffer(row["g"]) for row in rows), np.zeros(1 + p * p + REPLAY * REPLAY))
        return cells[0], cells[1:1 + p * p].reshape(p, p), cells[1 + p * p:].reshape(REPLAY, REPLAY)

    maps, shortest = [], np.inf
    for round_ in range(iters + 1):
        left, g, steps = summed(maps)
        if round_ and np.sqrt(left) <= tol * np.sqrt(sq):
            break
        if round_ == iters:
            raise RuntimeError(f"no split after {iters} rounds: {np.sqrt(left / sq):.3g} left")
        if len(maps) == REPLAY:
            combine = round_ >= PLAIN and steps[-1, -1] < shortest
            weights = _cancelling(steps) if combine else np.eye(REPLAY)[-1]
            state, maps = settle(state.mapInArrow(write(maps, weights), blocked), "split"), []
            if combine:
                shortest = steps[-1, -1]
                _, g, _ = summed(maps)
        w, v = np.linalg.eigh((g + g.T) / 2)
        s = np.sqrt(np.maximum(w, 0))
        keep = np.where(s > 0, np.maximum(1 - (1 / mu) / np.where(s > 0, s, 1), 0), 0)
        maps = [*maps, v @ np.diag(keep) @ v.T]
    out = settle(state.mapInArrow(parts(maps), f"`{id_}` {id_type}, low array<double>, s array<double>"), "split")
    return out.select(id_, *[F.col("low")[i].alias(f"{c}_low") for i, c in enumerate(cols)], *[F.col("s")[i].alias(f"{c}_sparse") for i, c in enumerate(cols)])


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation per feature from the uncentred regression on the others."""
    n, _, m = moment_matrix(df, cols, centre=False)
    inv = np.linalg.inv(m)
    rows = [(c, float(inv[i, i] * m[i, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def pc_influence(df: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """Cosine between the first component over time with and without each
    subject; influential when below mean - 2 sd. `time` is an integer index;
    times missing for any subject are left out, and so are rows with a null.

    With each time's mean taken off, the scatter over time is the sum of the
    subjects' own products. It has the same spectrum as the products between
    subjects, which one pass over blocks of time sums, whatever the number of
    times. Leaving a subject out takes a multiple of its own product off, so its
    first component is a root of one equation in the whole set's components:
    a rank-one change, solved for all subjects at once. One number per pair of
    subjects reaches the driver, none per time.

    Below three subjects, or where the whole doesn't vary, the cosine is null;
    if two components tie for the first, it refers to one of them."""
    d = df.select(F.col(subject).alias("__who"), F.col(time).alias("__t"), F.col(value).cast("double").alias("__v")).dropna()
    d = with_row(d, d.agg(F.countDistinct("__who").alias("__all")))
    d = with_stats(d, ["__t"], {"__here": F.count(F.lit(1)), "__m": F.avg("__v")}).where("__here = __all")
    d = d.select("__who", "__t", (F.col("__v") - F.col("__m")).alias("__v"), F.lit(0).alias("__set"))
    products = pairwise_moments(d, ["__set"], "__who", "__t", "__v", centre=False, diagonal=True)
    rows = products.select("a", "b", "sxy").collect()
    names = sorted({r["a"] for r in rows})
    place = {name: i for i, name in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in rows:
        gram[place[r["a"]], place[r["b"]]] = gram[place[r["b"]], place[r["a"]]] = r["sxy"]
    cos = _left_out(gram).tolist()
    schema = f"`{subject}` {dict(df.dtypes)[subject]}, similarity double"
    out = df.sparkSession.createDataFrame([(n, None if c != c else c) for n, c in zip(names, cos)], schema)
    cut = out.agg((F.avg("similarity") - 2 * F.stddev_samp("similarity")).alias("__cut"))
    return with_row(out, cut).withColumn("influential", F.col("similarity") < F.col("__cut")).drop("__cut")


def _left_out(gram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each row: |cosine| between the first component of the whole and that
    of the others, from the products of the centred rows.

    Let l_k be the whole's eigenvalues and z_k the row's coordinates. Without
    the row the first eigenvalue is l_1 - t with
    n / (n - 1) * (z_1^2 / t - sum_k>1 z_k^2 / (l_1 - l_k - t)) = 1, which falls
    in t, and the component's coordinates are z_1 / t and -z_k / (l_1 - l_k - t)."""
    n = len(gram)
    if n < 3:
        return np.full(n, np.nan)
    w, v = np.linalg.eigh(gram)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    if w[0] <= 0:
        return np.full(n, np.nan)
    z, gap = v * np.sqrt(w), w[0] - w[1:]

    def sides(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = gap - t[:, None]
            return np.where(z[:, 0] == 0, 0, z[:, 0] / t), np.where(z[:, 1:] == 0, 0, z[:, 1:] / rest)

    low, high = np.zeros(n), np.full(n, gap[0])
    for _ in range(rounds):
        t = (low + high) / 2
        first, rest = sides(t)
        up = n / (n - 1) * (z[:, 0] * first - (z[:, 1:] * rest).sum(axis=1)) > 1
        low, high = np.where(up, t, low), np.where(up, high, t)
    first, rest = sides(high)
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.abs(first) / np.sqrt(first**2 + (rest**2).sum(axis=1))
    # A row without a part in the first component leaves it as it is; where no
    # root lies before the second eigenvalue, the second component takes over.
    return np.where(z[:, 0] == 0, 1.0, np.where((low >= gap[0] * (1 - 1e-15)) & (z[:, 1] == 0), 0.0, cos))
