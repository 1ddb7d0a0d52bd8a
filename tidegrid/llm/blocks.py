"""Repeated word windows by fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window; those
blocks are the reference index. Each rolling window of block length of every
document probes the index by hash. A window of `length` words that occurs
twice holds a whole block, which is then hit elsewhere; so only windows around
hit blocks are extended to `length` words and confirmed, and confirmed windows
that overlap merge to maximal exact repeats.

Index and probes meet in buckets as sorted distinct hashes (about two bytes
each, see packs.py); a probe's hash is short there, since a chance hit only
costs an extension that fails. The extension compares 64 bits of the whole
window's content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import packs as P
from tidegrid.llm.text import U, Rolling, Words, flat, runs, spread, sum_by

#: Text per bucket.
BUCKET_BYTES = 12 << 20


class _Windows:
    """Window hashes of the documents of a pack."""

    def __init__(self, batch: pa.RecordBatch, text_col: str):
        h, self.first = P.pack_words(batch, text_col)
        self.roll, self.n = Rolling(h), len(h)
        self.inside = np.arange(self.n) - np.repeat(self.first[:-1], np.diff(self.first))
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n words, and their hashes."""
        at = np.flatnonzero(self.left >= n)
        return at, self.roll.windows(n)[at]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and those that are there twice or more."""
    v = np.sort(values)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    again = v[1:][~new[1:]]
    return v[new], np.unique(again)


def _sent(bits: int, pack: int, named: dict[str, list[bytes]], keep: list[int]) -> pa.Table:
    return pa.table({"bucket": pa.array(keep, pa.int32()), "pack_id": pa.array([pack] * len(keep), pa.int64()), **{k: pa.array([v[i] for i in keep], pa.binary()) for k, v in named.items()}})


def repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", cut: bool = False, pack_bytes: int = P.PACK_BYTES) -> DataFrame:
    """Words covered by a window of `length` words whose word sequence also
    starts anywhere else, in the same or another row.

    Returns one row per input row: the id, n_words, n_removed, kept_sha256
    (kept words joined by one space), spans (array of word ranges [start,
    end), the maximal repeats). With `cut`, all columns of the input instead,
    the text without its repeats: the bytes from the first to the last word of
    a span go, with the white space that follows. Windows are judged on the
    input; all copies of a repeat go. A null or short text has no window (null
    stays null with `cut`); a null id stays null; a repeated row repeats its
    windows. Nothing in gives nothing out.
    """
    block = (length + 1) // 2
    docs = docs if cut else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_col, text_col = (id_col, text_col) if cut else ("doc_id", "text")
    fields = docs.schema
    held = P.packed(docs, text_col, pack_bytes)
    bits = P.bucket_bits(held, BUCKET_BYTES)
    shift = U(64 - bits - 24)

    def probe(batches):
        for batch in batches:
            for pack, body in zip(batch.column("pack_id").to_pylist(), batch.column("body")):
                w = _Windows(P.unpack(body), text_col)
                at, h = w.of(block)
                h = h >> shift
                lists = dict(zip(("probes", "twice"), _distinct(h)), blocks=np.unique(h[w.inside[at] % block == 0]))
                named, some = {}, set()
                for k, v in lists.items():
                    cuts = P.by_bucket(v << shift, bits)
                    named[k] = [P.gaps(v[a:b] & U(0xFFFFFF)) for a, b in zip(cuts, cuts[1:])]
                    some |= {i for i, x in enumerate(named[k]) if x}
                yield from _sent(bits, pack, named, sorted(some)).to_batches()

    def hit(rows: pa.Table) -> pa.Table:
        seen, indexed = np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, bool)
        got = [P.ungaps(x.as_py()) for x in rows.column("probes")]
        for v in got:
            seen[v] = np.minimum(seen[v], 1) + 1
        for x, b in zip(rows.column("twice"), rows.column("blocks")):
            seen[P.ungaps(x.as_py())] = 2
            indexed[P.ungaps(b.as_py())] = True
        indexed &= seen > 1
        hits = [P.gaps(v[indexed[v]]) for v in got]
        return pa.table({"bucket": rows.column("bucket"), "pack_id": rows.column("pack_id"), "hits": pa.array(hits, pa.binary())})

    hits = P.exchange(held.mapInArrow(probe, "bucket int, pack_id long, probes binary, twice binary, blocks binary"), hit, "bucket int, pack_id long, hits binary")

    def extend(batch: pa.RecordBatch, answers: pa.Table, pack: int) -> pa.Table:
        w = _Windows(batch, text_col)
        live = [np.zeros(0, U)]
        for b, x in zip(answers.column("bucket").to_pylist(), answers.column("hits")):
            live.append(P.ungaps(x.as_py()).astype(U) + (U(b) << U(24)))
        live = np.sort(np.concatenate(live))
        # A window is a candidate if the first whole block in it was hit.
        at, h = w.of(length)
        start = at + (-w.inside[at]) % block
        small = w.roll(start, start + block) >> shift
        near = np.searchsorted(live, small)
        is_live = np.zeros(len(at), bool)
        if len(live):
            is_live = live[np.minimum(near, len(live) - 1)] == small
        values, _ = _distinct(h[is_live])
        cuts = P.by_bucket(values, bits)
        lists = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return _sent(bits, pack, {"windows": lists}, [i for i, x in enumerate(lists) if x])

    def confirm(rows: pa.Table) -> pa.Table:
        got = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("windows")]
        again = _distinct(np.concatenate(got))[1]
        out = []
        for v in got:
            at = np.searchsorted(again, v)
            out.append((v[again[np.minimum(at, len(again) - 1)] == v] if len(again) else v[:0]).tobytes())
        return pa.table({"bucket": rows.column("bucket"), "pack_id": rows.column("pack_id"), "again": pa.array(out, pa.binary())})

    asked = P.told(held, hits, extend, "bucket int, pack_id long, windows binary")
    confirmed = P.exchange(asked, confirm, "bucket int, pack_id long, again binary")

    def finish(batch: pa.RecordBatch, answers: pa.Table, pack: int) -> pa.Table:
        w = _Windows(batch, text_col)
        at, h = w.of(length)
        again = np.concatenate([np.zeros(0, U), *(np.frombuffer(x.as_py(), np.uint64) for x in answers.column("again"))])
        again = np.sort(np.concatenate([again, _distinct(h)[1]]))  # and what repeats within the pack
        where = np.zeros(w.n, bool)
        if len(again) and len(h):
            where[at] = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
        gone = spread(where, length)
        begin, end, doc = runs(gone, w.first)
        if cut:
            return _cut(batch, gone, w.first, text_col)
        inside = (begin - w.first[doc], end - w.first[doc])
        pairs = pa.StructArray.from_arrays([pa.array(x) for x in inside], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), pairs)
        texts = (x.encode() if x else b"" for x in batch.column(text_col).to_pylist())
        sha = []
        for t, a, b, any_gone in zip(texts, w.first, w.first[1:], sum_by(gone, w.first)):
            words = t.split()
            if any_gone:
                words = [x for x, g in zip(words, gone[a:b]) if not g]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(sum_by(gone, w.first)), "kept_sha256": pa.array(sha), "spans": spans})

    if cut:
        return P.told(held, confirmed, finish, fields)
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([fields["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)])
    return P.told(held, confirmed, finish, out).withColumnRenamed("doc_id", id_col)


def _cut(batch: pa.RecordBatch, gone: np.ndarray, first: np.ndarray, text_col: str) -> pa.Table:
    """The documents without the words that go."""
    texts = batch.column(text_col).to_pylist()
    for d in np.flatnonzero(sum_by(gone, first)).tolist():
        raw = texts[d].encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        a, b, _ = runs(gone[first[d] : first[d + 1]], np.array([0, first[d + 1] - first[d]]))
        ends = np.append(w.start[1:], len(raw))  # the white space after a word goes with it
        keep = np.ones(len(raw), bool)
        for s, e in zip(w.start[a], ends[b - 1]):
            keep[s:e] = False
        texts[d] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
    return pa.Table.from_batches([batch]).set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, batch.schema.field(text_col).type))
