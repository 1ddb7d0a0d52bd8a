"""Benchmark decontamination: a BM25 index of test items, queried by every
passage of every document.

Items are cut into entries of SEGMENT words; documents into passages of twice
that, every SEGMENT words, so that a copied entry lies whole in some passage.
A weight is the BM25 contribution of a term to an entry, over the entry's own
score, so a passage scores 1 where it holds all of an entry's terms and one
threshold serves all entries.

Retrieval is block-max WAND with that fixed threshold, for all passages of a
slice at once: entries lie in blocks, a term stores its largest weight in each
block, and only blocks whose sum of bounds reaches the threshold are scored
exactly. Nothing above the threshold is missed. Retrieved pairs are verified on
five-word shingles around the passages: of the question part and of the answer
part of the item, at least `overlap` must be there.

The index is broadcast in shards of a bounded size, each a scan of the
documents without a shuffle; statistics are those of all items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.text import LOWER, U, Rolling, Words, flat, small_batches, texts_of
from tidegrid.operators.scan import time_index
from tidegrid.session import settle

K1, B = 1.2, 0.75
SEGMENT, SHINGLE, BLOCK = 64, 5, 8
THRESHOLD, OVERLAP = 0.6, 0.8
SHARD_BYTES = 8 << 20
_SPLIT = re.compile(rb"[.?!\n]\s")
#: Words of items and passages: A-Z in lower case, ASCII punctuation as white space.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32
_TERMS = "item long, part int, length long, term long, tf long"


def _as_bytes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode()
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def _plain(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(PLAIN[data], off)


def parts_of(text: str) -> tuple[bytes, bytes]:
    """Question and answer of an item: the answer is the last sentence or line,
    or the last quarter of the words of a text that has only one."""
    raw = text.encode().strip()
    cuts = [m.end() for m in _SPLIT.finditer(raw)]
    if cuts:
        return raw[: cuts[-1]], raw[cuts[-1] :]
    w = raw.split()
    at = len(w) - max(1, len(w) // 4)
    return b" ".join(w[:at]), b" ".join(w[at:])


def shingles(raw: bytes) -> tuple[int, np.ndarray]:
    """Shingle length (SHINGLE, or all words of a shorter text) and hashes."""
    h = _plain(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes()
    n = min(SHINGLE, len(h))
    return n, np.unique(Rolling(h).windows(n)) if n else np.zeros(0, U)


@dataclass
class Shard:
    """Entries in blocks of BLOCK; for term t the blocks are tb[t]:tb[t + 1],
    and for its block b the postings are bp[b]:bp[b + 1]."""

    terms: np.ndarray
    tb: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    bp: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    item: np.ndarray
    checks: list


def _shard(rows: pa.Table, texts: dict[int, str], n_entries: int, mean: float) -> Shard:
    """The index of one shard from its postings, which carry document frequencies."""
    col = {c: rows.column(c).to_numpy() for c in rows.column_names}
    _, entry = np.unique(col["item"] * (1 << 20) + col["part"], return_inverse=True)
    idf = np.log1p((n_entries - col["df"] + 0.5) / (col["df"] + 0.5))
    w = idf * col["tf"] * (K1 + 1) / (col["tf"] + K1 * (1 - B + B * col["length"] / mean))
    w /= np.bincount(entry, w)[entry]
    terms, term = np.unique(col["term"].view(np.uint64), return_inverse=True)
    order = np.lexsort((entry, term))
    term, entry_s, w = term[order], entry[order], w[order]
    block = entry_s // BLOCK
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    item = np.zeros(entry.max() + 1 if len(entry) else 0, np.int64)
    item[entry] = col["item"]
    checks = {i: [shingles(p) for p in parts_of(t)] for i, t in texts.items()}
    return Shard(terms, np.searchsorted(term[first], np.arange(len(terms) + 1)), block[first], np.maximum.reduceat(w, first) if len(w) else w,
                 np.append(first, len(term)), entry_s, w, item, checks)


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a CSR index: position in `rows`, and index of each element."""
    n = first[rows + 1] - first[rows]
    own = np.repeat(np.arange(len(rows)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)


def _search(data: np.ndarray, off: np.ndarray, s: Shard, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of verified pairs."""
    w = _plain(data, off)
    h = w.hashes()
    if not len(s.terms) or not len(h):
        return []
    near = np.minimum(np.searchsorted(s.terms, h), len(s.terms) - 1)
    at = np.flatnonzero(s.terms[near] == h)
    doc = w.docs()[at]
    inside = (at - w.first[doc]) // SEGMENT
    # Passage p of a document holds segments p and p + 1.
    n_pass = np.maximum(1, -(-w.counts // SEGMENT))
    base = np.cumsum(n_pass) - n_pass
    passage = base[doc] + inside
    both = np.concatenate([passage, passage[inside > 0] - 1])
    pair = np.unique(both * len(s.terms) + np.concatenate([near[at], near[at][inside > 0]]))
    passage, term = pair // len(s.terms), pair % len(s.terms)
    n_blocks = -(-len(s.item) // BLOCK)
    own, b = _expand(s.tb, term)
    cell = passage[own] * n_blocks + s.block[b]
    cells, at = np.unique(cell, return_inverse=True) if n_blocks > 4096 else (None, cell)
    alive = np.bincount(at, s.bound[b])[at] >= threshold - 1e-9
    own, b = own[alive], b[alive]
    up, post = _expand(s.bp, b)
    key, at = np.unique(passage[own][up] * len(s.item) + s.entry[post], return_inverse=True)
    score = np.bincount(at, s.weight[post], len(key))
    good = score >= threshold - 1e-9
    if not good.any():
        return []
    found: dict[tuple[int, int], list] = {}
    for k, x in zip(key[good].tolist(), score[good].tolist()):
        p = k // len(s.item)
        d = int(np.searchsorted(base, p, "right")) - 1
        old = found.setdefault((d, int(s.item[k % len(s.item)])), [x, p - base[d], p - base[d]])
        found[d, int(s.item[k % len(s.item)])] = [max(old[0], x), min(old[1], p - base[d]), max(old[2], p - base[d])]
    out = []
    for (d, item), (x, lo, hi) in found.items():
        a, e = int(w.first[d] + max(0, (lo - 1) * SEGMENT)), int(min(w.first[d + 1], w.first[d] + (hi + 3) * SEGMENT))
        roll = Rolling(h[a:e])
        share = [np.isin(hs, roll.windows(n)).mean() if n else 1.0 for n, hs in s.checks[item]]
        if min(share) >= overlap:
            out.append((d, item, x, *map(float, share)))
    return out


def _index(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Shard, dict]]:
    """The shards of the index; each with the ids of its items."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    # Numbered, as a hash short enough for the keys below would meet another one.
    items = settle(time_index(items.withColumn("all", F.lit(0)), ["all"], ["text", "id"], out="item").select("id", "text", F.col("item").cast("long").alias("item")), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                h = _plain(*_as_bytes(text)).hashes()
                for part in range(-(-len(h) // SEGMENT)):
                    own = h[part * SEGMENT : (part + 1) * SEGMENT]
                    if part and len(own) < SEGMENT:
                        own = h[-SEGMENT:]
                    t, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(t), k) for x, k in ((item, pa.int64()), (part, pa.int32()), (len(own), pa.int64()))] + [pa.array(t.view(np.int64)), pa.array(n)], names=["item", "part", "length", "term", "tf"])

    posts = items.select("item", "text").mapInArrow(terms, _TERMS)
    posts = posts.join(posts.groupBy("term").agg(F.count("*").alias("df")), "term")
    entries = posts.groupBy("item", "part").agg(F.first("length").alias("n"))
    n_entries, mean = entries.agg(F.count("*"), F.avg("n")).first()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    for k in range(shards):
        here = f"pmod(item, {shards}) = {k}"
        rows = posts.where(here).toArrow()
        texts = items.where(here).select("item", "id", "text").toArrow().to_pylist()
        if rows.num_rows:
            yield _shard(rows, {x["item"]: x["text"] for x in texts}, n_entries, mean), {x["item"]: x["id"] for x in texts}


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Verified pairs: doc_id, item_id, score (0 to 1, the largest over the
    passages), question_overlap and answer_overlap.

    Words are compared in lower case (A-Z) and without ASCII punctuation. A document or item without words
    gives no pair; an item without a question part is judged on its answer. A
    null id stays null; equal items count once; a repeated document gives its
    pairs again; no documents or no items give no rows."""
    small_batches(docs)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type, item_arrow = items.schema[item_col].dataType, items.select(item_col).limit(0).toArrow().schema.field(0).type
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", item_type), *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])
    result = docs.sparkSession.createDataFrame([], out)
    for shard, names in _index(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast((shard, names))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard, names = sent.value
            for batch in batches:
                for part in texts_of(batch):
                    got = _search(*flat(part.column("text")), shard, threshold, overlap)
                    if got:
                        d, item, *nums = zip(*got)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array([names[i] for i in item], item_arrow), *(pa.array(x, pa.float64()) for x in nums)], names=out.names)

        result = result.unionAll(source.mapInArrow(run, out))
    return result.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents that hold no verified item, with all their columns; the
    rules are those of `leaks`. No shuffle."""
    small_batches(docs)
    for shard, _ in _index(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in texts_of(batch, column=text_col):
                    hit = {d for d, *_ in _search(*flat(part.column(text_col)), sent.value, threshold, overlap)}
                    yield part.take(pa.array([i for i in range(part.num_rows) if i not in hit], pa.int64())) if hit else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
