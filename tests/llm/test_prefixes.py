"""The prefix trie against a plain version, and tree sums on odd shapes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidegrid.llm import prefixes
from tidegrid.llm.queries import QUERIES


def plain(convs):
    """{conv_id: [(role, text), ...]} -> rows of the trie."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def rebuilt(rows):
    own = defaultdict(list)
    for c, k, role, text in rows:
        own[c].append((k is not None, k or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows():
    r = random.Random(3)
    out = [(c, k, ("user", "assistant")[k % 2], f"common {min(k, r.randint(0, 3))}") for c in range(130) for k in range(r.randint(1, 9))]
    out += [(200 + c, k, "user", f"the same {k}") for c in range(60) for k in range(6)]  # copies of one another
    out += [(300, None, None, None), (300, 0, "user", "é😀"), (300, 0, "user", "é😀"), (301, 0, "", ""), (777, 0, "user", "no base"), (778, 3, None, "x"), (None, 0, "user", "no id")]
    out += [(400, k, "user", f"long {k}") for k in range(70)] + [(401, k, "user", f"long {k}") for k in range(45)] + [(402, k, "user", f"long {k}" if k < 30 else "other") for k in range(50)]
    return out + [(500, 0, "user", "x" * 300_000)]


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("pieces", [False, True])
def test_query(spark, tmp_path, pieces, request):
    if pieces:
        request.getfixturevalue("tiny_pieces")
    data = rows()
    frame(spark, data).repartition(3).selectExpr("*", "1 AS depth", "2 AS k1", "'x' AS pos").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect()
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(r[n] for n in names) for r in got) == plain(rebuilt(data))


def test_many_ends_pass_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK_BITS", 3)
    ids = [-9, -8, -1, 0, 5, 7, 8, 1000, 1 << 60, *range(20_000, 20_300)]
    convs = spark.createDataFrame([(c,) for c in ids], "conv_id long")
    turns = spark.createDataFrame([(c, 0, "user", "a") for c in ids if c % 2 == 0], "conv_id long, pos long, role string, text string")
    got = sorted(prefixes.prefix_trie(turns, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())
    assert list(map(tuple, got)) == plain({c: [("user", "a")] if c % 2 == 0 else [] for c in ids})


def test_empty(spark):
    none = prefixes.numbered(frame(spark, []))
    assert prefixes.prefix_trie(none, none.select("conv_id")).count() == 0
    one = prefixes.prefix_trie(none, spark.createDataFrame([(4,), (3,)], "conv_id long")).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"]) for r in one] == [(3, 0, 2, 1)]


def shapes():
    r = random.Random(1)
    yield "chain", [None, *range(120)]
    yield "star", [None, *[0] * 300]
    yield "random", [None, *[r.randrange(k) for k in range(1, 200)]]
    yield "comb", [None, *[k - 1 if k % 2 else k - 2 for k in range(1, 90)]]
    yield "forest", [None, None, 0, 1, 2, None]
    yield "nothing", []


@pytest.mark.parametrize("name, parent", list(shapes()), ids=[n for n, _ in shapes()])
def test_tree_sums(spark, name, parent):
    # A second long column tells nodes apart that share the first.
    key = [(k // 3, k % 3) for k in range(len(parent))]
    data = [(*key[k], *(key[p] if p is not None else (None, None)), k + 1, 2 * k) for k, p in enumerate(parent)]
    df = spark.createDataFrame(data, "a long, b long, pa long, pb long, v long, w long")
    want = {key[k]: [k + 1, 2 * k] for k in range(len(parent))}
    for k in reversed(range(len(parent))):
        if parent[k] is not None:
            for i in (0, 1):
                want[key[parent[k]]][i] += want[key[k]][i]
    got = prefixes.subtree_sums(df, ["a", "b"], ["pa", "pb"], ["v", "w"]).collect()
    assert {(r["a"], r["b"]): [r["v"], r["w"]] for r in got} == want and len(got) == len(want)
