"""The trie of shared conversation prefixes, with totals of every subtree.

Each distinct sequence of first turns is a node. It is known by its depth and
two independent 64-bit hashes of its turns: running sums of hashes of (place,
turn), so the prefixes of a conversation of any length are an ordinary scan.

Totals over subtrees come from parallel tree contraction. A round rakes all
leaves (a leaf hands its total to its parent, combined before the shuffle) and
compresses unary chains (a node with one child, whose hash is below those of
its parent and its child, is cut out; the child takes its place and carries
what was cut out on its edge). A chain loses a third of its nodes a round, a
bushy tree its leaves, so the rounds grow with the logarithm of the nodes. What
was cut out is written down as (node, child, own part) and expanded at the end:
pointers along these records are doubled until they reach a raked node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import cut, scan, time_index
from tidegrid.session import settle

KEY = ["depth", "k1", "k2"]
CHUNK_BITS = 12


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, role, text): place of each turn in its conversation from 0
    on, in the order of `turn`, null first, at ties by role and text. A null role
    or text is empty; rows without an id belong to no conversation and go."""
    d = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return time_index(d, ["conv_id"], ["turn", "role", "text"], out="pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text")


def _key(sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(s), *sums) for s in (1, 2)]


def _members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2 of its prefix, p1, p2 of the prefix before, chars)."""
    hashes = [F.xxhash64(F.lit(s), "pos", "role", "text") for s in (11, 12)]
    # Sums of 32-bit halves stay exact.
    halves = {f"h{i}{n}": part for i, h in enumerate(hashes) for n, part in (("a", F.shiftrightunsigned(h, 32)), ("b", h.bitwiseAND(F.lit(0xFFFFFFFF))))}
    d = settle(turns.select("conv_id", "pos", F.length("text").cast("long").alias("chars"), *[v.alias(n) for n, v in halves.items()]), "turns")
    run = scan(cut(d, ["conv_id"], ["pos"]), total={f"s{n}": F.col(n) for n in halves})
    now, before = _key([F.col(f"s{n}") for n in halves]), _key([F.col(f"s{n}") - F.col(n) for n in halves])
    return run.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), *[v.alias(n) for n, v in zip(("k1", "k2", "p1", "p2"), now + before)], "chars")


def _root_key() -> list[Column]:
    return [F.lit(0).cast("long"), *_key([F.lit(0).cast("long")] * 4)]


def _digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of the sorted, comma-joined ids at each key. Ids are
    joined in chunks of neighbouring ids, a row each, and a key's chunks pass
    through its digest one after another; no task holds the ids of a key."""
    part = ends.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(k).to_pylist() for k in (*KEY, "ids")]):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield rows(out)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        *key, sha = zip(*out)
        return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in key], pa.array(sha, pa.string())], names=[*KEY, "ends_sha256"])

    return part.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, node: list[str], parent: list[str], values: list[str]) -> DataFrame:
    """(node, values) with each value summed over the node's subtree, by tree
    contraction. `node` and `parent` name two long columns each; the parent of a
    root is null. Values are long and not null. Nodes must be distinct and
    parents exist; a forest and an empty table are fine."""
    n, p = ["n1", "n2"], ["p1", "p2"]
    edge = [f"e{i}" for i in range(len(values))]
    acc = [f"a{i}" for i in range(len(values))]
    d = nodes.select(*[F.col(c).alias(x) for c, x in zip([*node, *parent, *values], [*n, *p, *acc])])
    kids = d.where("p1 is not null").groupBy(*[F.col(x).alias(y) for x, y in zip(p, n)]).agg(F.count("*").alias("kids"))
    active = settle(d.join(kids, n, "left").select(*n, *p, F.coalesce("kids", F.lit(0)).alias("kids"), *acc, *[F.lit(0).cast("long").alias(e) for e in edge]), "tree")
    raked, spliced, round_ = [], [], 0
    while not active.where("p1 is not null").isEmpty():
        leaf = (F.col("kids") == 0) & F.col("p1").isNotNull()
        raked.append(active.where(leaf).select(*n, *acc))
        gain = active.where(leaf).groupBy(*[F.col(x).alias(y) for x, y in zip(p, n)]).agg(
            F.count("*").alias("gone"), *[F.sum(F.col(a) + F.col(e)).alias(f"g{a}") for a, e in zip(acc, edge)])
        rest = active.where(~leaf).join(gain, n, "left").select(
            *n, *p, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *[(F.col(a) + F.coalesce(f"g{a}", F.lit(0))).alias(a) for a in acc], *edge)
        only = rest.where("p1 is not null").groupBy(*[F.col(x).alias(y) for x, y in zip(p, n)]).agg(
            F.count("*").alias("left"), F.max(F.struct(*n, *edge)).alias("child")).where("left = 1").drop("left")

        def luck(*cols: str) -> Column:
            return F.xxhash64(F.lit(round_), *cols)

        out = F.col("p1").isNotNull() & F.col("child").isNotNull() & (luck(*n) < luck(*p)) & (luck(*n) < luck("child.n1", "child.n2"))
        marked = settle(rest.join(only, n, "left").withColumn("out", F.coalesce(out, F.lit(False))), "tree")
        cuts = marked.where("out")
        spliced.append(cuts.select(*n, *[F.col(f"child.{x}").alias(f"c{x}") for x in n], *[(F.col(a) + F.col(f"child.{e}")).alias(a) for a, e in zip(acc, edge)]))
        moved = cuts.select(
            *[F.col(f"child.{x}").alias(x) for x in n], *[F.col(x).alias(f"m{x}") for x in p], *[(F.col(a) + F.col(e)).alias(f"m{e}") for a, e in zip(acc, edge)])
        active = settle(marked.where("not out").join(moved, n, "left").select(
            *n, *[F.coalesce(f"m{x}", x).alias(x) for x in p], "kids", *acc, *[(F.col(e) + F.coalesce(f"m{e}", F.lit(0))).alias(e) for e in edge]), "tree")
        round_ += 1
    known = reduce(DataFrame.unionAll, raked, active.select(*n, *acc))
    if spliced:
        c = [f"c{x}" for x in n]
        hop = settle(reduce(DataFrame.unionAll, spliced), "hops")
        while True:
            ahead = hop.select(*[F.col(x).alias(y) for x, y in zip(n, c)], *[F.col(x).alias(f"t{x}") for x in c], *[F.col(a).alias(f"t{a}") for a in acc])
            hop = settle(hop.join(ahead, c, "left").select(
                *n, *[F.coalesce(f"t{x}", x).alias(x) for x in c], *[(F.col(a) + F.coalesce(f"t{a}", F.lit(0))).alias(a) for a in acc], F.col(f"t{c[0]}").isNotNull().alias("far")), "hops")
            if hop.where("far").isEmpty():
                break
        ends = known.select(*[F.col(x).alias(y) for x, y in zip(n, c)], *[F.col(a).alias(f"t{a}") for a in acc])
        known = known.unionAll(hop.join(ends, c).select(*n, *[(F.col(a) + F.col(f"t{a}")).alias(a) for a in acc]))
    return known.select(*[F.col(x).alias(y) for x, y in zip([*n, *acc], [*node, *values])])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie: conv_id (smallest member), depth,
    parent_conv_id (of the root: null), n_convs (members), n_children, n_leaves,
    saved_tokens and ends_sha256.

    `turns` has conv_id, pos (0, 1, ... in each conversation), role and text, as
    `numbered` makes them; `convs` has one conv_id per conversation, those
    without turns too, which end at the root. n_leaves and saved_tokens are of
    the subtree: childless nodes, and (members - 1) x code points of the node's
    last text, summed. ends_sha256 is of the sorted ids of the members that end
    at the node. Equal conversations share all nodes. Without conversations there
    is no row. Other columns are not read.

    Nodes are grouped with partial aggregation, so a first turn that a third of
    all conversations share is a counter. A child finds its parent in a join that
    adaptive execution splits where a parent has very many children.
    """
    convs = convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()
    members = settle(_members(turns), "members")
    inner = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    null = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[v.alias(k) for k, v in zip(KEY, _root_key())], "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), null.alias("p1"), null.alias("p2"))
    nodes = settle(inner.unionByName(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = settle(nodes.join(above, ["depth", "p1", "p2"], "left").select(
        *KEY, "conv_id", "parent_conv_id", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("parent_depth"), "n_convs", "chars"), "nodes")
    kids = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(F.count("*").alias("n_children"))
    tree = settle(linked.join(kids, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    sums = subtree_sums(tree, ["conv_id", "depth"], ["parent_conv_id", "parent_depth"], ["n_leaves", "saved_tokens"])
    last = members.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{k}"), v).alias(k) for k, v in zip(KEY, _root_key())])
    out = tree.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(_digests(ends), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
