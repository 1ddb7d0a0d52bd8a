"""Near-duplicate documents: a multi-index Hamming join over b-bit minhash
signatures, confirmed on the full shingle sets.

1. Each document becomes its set of distinct word shingles (64-bit hashes), a
   fingerprint of the set and a signature of minhashes of 16 bits, as many and
   in as many chunks as `layout` takes for the similarity asked for.
   Documents of equal sets form a class, represented by its smallest id.
2. Two signatures that differ in fewer than twice as many symbols as there are
   chunks have, by pigeonhole, a chunk with one error at most; so every chunk is filed once per position with that symbol left out,
   and such a pair shares a key. Buckets of equal members count once.
3. Inside a bucket, members within the distance are linked; the linked classes
   form candidate clusters. The sets of a cluster meet, and links are confirmed
   by intersection and union sizes of the full sets.

A bucket or cluster beyond a fixed size is dealt to blocks, and every pair of
blocks is one task: each pair of documents meets somewhere, whatever the size.
Tasks return a spanning forest of what they linked, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.graph import components
from tidegrid.llm.text import U, Rolling, Words, flat, mix, small_batches, texts_of
from tidegrid.session import settle

SHINGLE = 5
#: Symbols of the longest signature.
MOST = 65
#: Signatures in a block of a bucket; documents and shingles in a block of a cluster.
BUCKET_BLOCK, CLUSTER_DOCS, CLUSTER_SHINGLES = 4096, 2000, 400_000
_RNG = np.random.Generator(np.random.PCG64(7))
MULT = _RNG.integers(1, 1 << 63, MOST, dtype=np.uint64) * U(2) + U(1)
ADD = _RNG.integers(0, 1 << 63, MOST, dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """Chunks of a signature and symbols of a chunk. Every pair within a
    distance of `reach` shares a key."""

    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def reach(self) -> int:
        return 2 * self.chunks - 1

    def missed(self, percent: int) -> float:
        """Chance that a pair of this similarity is farther apart than `reach`."""
        n, p = self.symbols, 1 - percent / 100
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.reach + 1, n + 1))


def layout(percent: int) -> Layout:
    """The layout that misses a pair at `percent` with a chance of one in a million at most."""
    return Layout(13, 5) if percent >= 85 else Layout(14, 4)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, A-Z lower-cased, and
    their offsets. With fewer than n words the whole sequence is the one
    shingle; without words there is none."""
    w = Words(data, off)
    roll = Rolling(w.hashes(lower=True))
    doc = w.docs()
    full = np.flatnonzero(w.within(n))
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    h = np.concatenate([roll.windows(n)[full], roll(w.first[short], w.first[short + 1])])
    d = np.concatenate([doc[full], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(off)))


def _signatures(h: np.ndarray, first: np.ndarray, symbols: int) -> np.ndarray:
    """`symbols` minhashes of 16 bits for each non-empty set."""
    out = np.empty((len(first) - 1, symbols), np.uint16)
    buf = np.empty(len(h), U)
    for k in range(symbols):
        np.multiply(h, MULT[k], out=buf)
        np.add(buf, ADD[k], out=buf)
        out[:, k] = (mix(np.minimum.reduceat(buf, first[:-1])) >> U(48)).astype(np.uint16)
    return out


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"


def signed(docs: DataFrame, symbols: int) -> DataFrame:
    """doc_id, set size, fingerprint and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch):
                h, first = shingle_sets(*flat(part.column("text")))
                n = np.diff(first)
                some = n > 0
                sig = np.full(len(n), None, object)
                f = np.zeros((2, len(n)), U)
                if some.any():
                    starts = np.append(first[:-1][some], len(h))
                    sig[some] = [x.tobytes() for x in _signatures(h, starts, symbols)]
                    f[:, some] = np.add.reduceat(mix(h), starts[:-1]), np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), starts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(list(sig), pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.mapInArrow(run, _SIGNED)


def _keys(classes: DataFrame, form: Layout) -> DataFrame:
    """(key, class_id): each chunk with each of its symbols left out."""
    symbols, width = form.symbols, form.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                s = np.frombuffer(flat(part.column("sig"))[0].tobytes(), np.uint16).reshape(-1, symbols).astype(U)
                keys = np.empty((len(s), symbols), U)
                for c in range(form.chunks):
                    for out in range(width):
                        x = np.zeros(len(s), U)
                        for k in range(width):
                            if k != out:
                                x = (x << U(16)) | s[:, c * width + k]
                        keys[:, c * width + out] = mix(mix(x) + U(c * width + out + 1))
                ids = np.repeat(part.column("class_id").to_numpy(zero_copy_only=False), symbols)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class_id"])

    return classes.select("class_id", "sig").mapInArrow(run, "key long, class_id long")


def _tiled(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once per pair of blocks (i <= j) that its block is part of; with
    one block, once."""
    df = df.withColumn("__b", F.expr(f"pmod(xxhash64(class_id, 11), {blocks})"))
    df = df.withColumn("__o", F.explode(F.expr(f"sequence(0, {blocks} - 1)")))
    return df.withColumns({"__i": F.least("__b", "__o"), "__j": F.greatest("__b", "__o")}).drop("__b", "__o").withColumn("tile", F.xxhash64(key, "__i", "__j")).drop("__i", "__j")


def _by_tile(df: DataFrame, link: Callable[[np.ndarray, pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Run `link` on the rows of each tile; rows stream through, one tile at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                rows = table.combine_chunks().to_batches()[0]
                tile = rows.column("tile").to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
                for a, b in link(cuts, rows):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            whole = int(np.searchsorted(tile == tile[-1], True))  # rows before the last tile of the batch
            if whole or held and held[-1].column("tile")[-1].as_py() != tile[0]:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield from done(pa.Table.from_batches(held))

    return df.repartition("tile").sortWithinPartitions("tile", "class_id").mapInArrow(run, "a long, b long")


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component of each of n members; near(x, free) gives those linked with x
    among the members that are still free. Members already reached are not
    compared again."""
    label, free, left = np.arange(n), np.ones(n, bool), n
    for root in range(n):
        if not free[root]:
            continue
        free[root], left = False, left - 1
        todo = [root]
        while todo and left:
            new = near(todo.pop(), free)
            free[new], label[new], left = False, root, left - len(new)
            todo += new.tolist()
    return label


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places start[0] to stop[0] - 1, start[1] to stop[1] - 1 and so on."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _linked_signatures(form: Layout) -> Callable:
    def link(cuts: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = rows.column("class_id").to_numpy()
        sig = np.frombuffer(flat(rows.column("sig"))[0].tobytes(), np.uint16).reshape(-1, form.symbols)
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        near = (sig[two] != sig[two + 1]).sum(axis=1) <= form.reach
        yield ids[two[near]], ids[two[near] + 1]
        for at, m in zip(cuts[:-1][size > 2], size[size > 2]):
            own, mine = sig[at : at + m], ids[at : at + m]

            def close(x: int, free: np.ndarray) -> np.ndarray:
                rest = np.flatnonzero(free)
                return rest[(own[rest] != own[x]).sum(axis=1) <= form.reach]

            label = _forest(m, close)
            far = np.flatnonzero(label != np.arange(m))
            if len(far):
                yield mine[label[far]], mine[far]

    return link


def _linked_sets(percent: int) -> Callable:
    """Links of the sets of a tile. Ordered from the tile's rarest shingle to its
    commonest, two sets that are linked share one of their first
    size - ceil(percent * size / 100) + 1 shingles. So a member only meets those
    that it shares one of these with, and members that are alike in their common
    shingles alone never meet."""

    def link(cuts: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, (raw, off) = rows.column("class_id").to_numpy(), flat(rows.column("shingles"))
        values, off = np.frombuffer(raw.tobytes(), U), off // 8
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            m = hi - lo
            if m < 2:
                continue
            first = off[lo : hi + 1] - off[lo]
            size = np.diff(first)
            _, dense, count = np.unique(values[off[lo] : off[hi]], return_inverse=True, return_counts=True)
            rank = np.empty(len(count), np.int64)
            rank[np.argsort(count, kind="stable")] = np.arange(len(count))
            member = np.repeat(np.arange(m), size)
            ranks = np.sort(member * len(count) + rank[dense]) - member * len(count)
            lead = size - (percent * size + 99) // 100 + 1
            ahead = np.arange(len(ranks)) - first[member] < lead[member]
            order = np.argsort(ranks[ahead], kind="stable")
            post = member[ahead][order]
            start = np.searchsorted(ranks[ahead][order], np.arange(len(count) + 1))
            mark = np.zeros(len(count), bool)

            def near(x: int, free: np.ndarray) -> np.ndarray:
                own = ranks[first[x] : first[x + 1]]
                met = post[_spans(start[own[: lead[x]]], start[own[: lead[x]] + 1])]
                met = np.unique(met[free[met]])
                met = met[100 * np.minimum(size[met], size[x]) >= percent * np.maximum(size[met], size[x])]
                if not len(met):
                    return met
                mark[own] = True
                both = np.add.reduceat(mark[ranks[_spans(first[met], first[met + 1])]], np.cumsum(size[met]) - size[met], dtype=np.int64)
                mark[own] = False
                return met[100 * both >= percent * (size[x] + size[met] - both)]

            label = _forest(m, near)
            far = np.flatnonzero(label != np.arange(m))
            if len(far):
                mine = ids[lo:hi]
                yield mine[label[far]], mine[far]

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (the smallest id of
    the same shingle set), component_id (the smallest id reachable over links,
    itself included) and kept (doc_id = component_id).

    Two documents are linked where 100 * |intersection| >= percent * |union| of
    their shingle sets, for percent >= 80. A null or blank text has the empty set and is
    linked with nothing. A row with a null id is linked with nothing, has null
    class and component, and is kept. Rows of one id count as one document.
    Other columns are not read. An empty input gives no rows."""
    if percent < 80:
        raise ValueError("the signature distance is made for similarities of 0.8 or more")
    form = layout(percent)
    small_batches(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = settle(signed(docs, form.symbols), "signed")
    named = sigs.where("n_shingles > 0 and doc_id is not null")
    same = ["f1", "f2", "n_shingles"]
    classes = settle(named.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig")), "classes")

    keys = _keys(classes, form)
    member = F.xxhash64("class_id", F.lit(5)).cast("decimal(20,0)")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum(member).alias("g1"), F.bit_xor(F.xxhash64("class_id", F.lit(9))).alias("g2"))
    buckets = buckets.where("n > 1").groupBy("n", "g1", "g2").agg(F.min("key").alias("key")).select("key", "n")
    met = _tiled(keys.join(buckets, "key"), "key", f"ceil(n / {BUCKET_BLOCK})").select("tile", "class_id")
    near = _by_tile(met.join(classes.select("class_id", "sig"), "class_id"), _linked_signatures(form))
    cluster = settle(components(near), "clusters").withColumnRenamed("id", "class_id").withColumnRenamed("label", "cluster")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch):
                h, first = shingle_sets(*flat(part.column("text")))
                blobs = [h[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("cluster"), pa.array(np.diff(first)), pa.array(blobs, pa.binary())], names=["class_id", "cluster", "n", "shingles"])

    # Merged whatever the size of the clusters' table, which has no bound.
    # Rows of one id may have different texts: each takes part under its id.
    full = docs.withColumnRenamed("doc_id", "class_id").join(cluster.hint("merge"), "class_id").select("class_id", "cluster", "text").mapInArrow(sets, "class_id long, cluster long, n long, shingles binary")
    full = settle(full.where("n > 0"), "sets")
    load = full.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CLUSTER_DOCS, F.sum("n") / CLUSTER_SHINGLES)).alias("blocks"))
    tiles = _tiled(full.join(load, "cluster"), "cluster", "blocks").select("tile", "class_id", "shingles")
    labels = components(_by_tile(tiles, _linked_sets(percent)))

    label = settle(labels, "labels").select(F.col("id").alias("class_id"), F.col("label").alias("component"))
    known = classes.select(*same, "class_id").join(label, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    out = sigs.select("doc_id", *same).join(known, same, "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = out.select(
        "doc_id", "n_shingles", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
