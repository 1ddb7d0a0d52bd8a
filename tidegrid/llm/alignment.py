"""Alignment of the tokens of two tokenizers over the same text.

Both token lists of a text spell the same bytes, so each token has a byte range
and each list its ascending byte ends. Of the two end lists of a document the
shorter drives: each of its ends is looked up in the longer one by galloping,
steps of 1, 2, 4, ... from where the last one was found and then a binary search
inside the last step. An end found in both lists closes a group; the difference
of two neighbouring ranks is the range of the other side's tokens that a token
overlaps. All documents of a slice gallop side by side, in lanes of consecutive
ends: lanes begin at the start of their document, and every step is an array
operation over the lanes.

How often a pair of ids is linked is counted in documents. Documents are cut
into packs of some MB; a pack sends each distinct pair once with its count,
gets back the counts of the corpus, and sums them for its documents.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.packs import gaps
from tidegrid.llm.text import SPACE, flat, small_batches, texts_of
from tidegrid.session import settle

LANE = 256
SLICE, PACK_BYTES = 1 << 20, 1 << 22
_STARTS_WORD = np.zeros(256, bool)  # first bytes of characters that are surely no white space
_STARTS_WORD[0x21:0x7F] = _STARTS_WORD[0xC3:0xE0] = _STARTS_WORD[0xE4:0xF5] = True


def take(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of the elements of the given rows of lists that begin at `first`."""
    n = first[rows + 1] - first[rows]
    return np.arange(int(n.sum())) + np.repeat(first[rows] - np.cumsum(n) + n, n)


def gallop(wanted: np.ndarray, listed: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each wanted value, how many of `listed` are below it. Both ascend;
    wanted[first[i]:first[i + 1]] are known to lie at or after place begin[i]."""
    rank = np.zeros(len(wanted), np.int64)
    size = np.diff(first)
    lanes = -(-size // LANE)
    own = np.repeat(np.arange(len(size)), lanes)
    at = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    end = np.minimum(at + LANE, first[own + 1])
    order = np.argsort(at - end, kind="stable")  # longest first: lanes that end drop off at the end
    at, end, low = at[order], end[order], begin[own][order]
    length = end - at
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, "left"))
        i = at[:live] + step
        low = _from(wanted[i], listed, low[:live])
        rank[i] = low
    return rank


def _from(x: np.ndarray, listed: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of the first listed values not below x, at or after `low`."""
    n = len(listed)
    low, high = low.copy(), low.copy()
    go = np.flatnonzero((high < n) & (listed[np.minimum(high, n - 1)] < x))
    step = 1
    while len(go):  # exponential: the value at `low` - 1 stays below x
        low[go] = high[go] + 1
        high[go] = np.minimum(high[go] + step, n)
        go = go[(high[go] < n) & (listed[np.minimum(high[go], n - 1)] < x[go])]
        step *= 2
    go = np.flatnonzero(low < high)
    while len(go):  # binary, inside the last step
        middle = (low[go] + high[go]) >> 1
        below = listed[middle] < x[go]
        low[go[below]] = middle[below] + 1
        high[go[~below]] = middle[~below]
        go = go[low[go] < high[go]]
    return low


@dataclass
class Side:
    """Tokens of all texts of a slice: ids, and where each text's begin."""

    ids: np.ndarray
    first: np.ndarray
    ends: np.ndarray  # byte end of each token in the slice


def aligned(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (in a, in b) of the tokens that end a group, and (in a, in b) of
    all links, both in order of the document and of a or, where b has fewer
    tokens, of b."""
    cuts, links = [], []
    na, nb = np.diff(a.first), np.diff(b.first)
    for x, y, docs, swap in ((a, b, np.flatnonzero(na <= nb), False), (b, a, np.flatnonzero(na > nb), True)):
        at = take(x.first, docs)
        first = np.append(0, np.cumsum(x.first[docs + 1] - x.first[docs]))
        rank = gallop(x.ends[at], y.ends, y.first[docs], first)
        both = y.ends[np.minimum(rank, len(y.ends) - 1)] == x.ends[at] if len(at) else np.zeros(0, bool)
        after = rank + both  # first of the tokens that the next one overlaps
        low = np.append(0, after[:-1])[: len(at)]
        some = first[:-1] < first[1:]
        low[first[:-1][some]] = y.first[docs][some]
        n = rank - low + 1
        here = np.repeat(at, n)
        there = np.arange(len(here)) + np.repeat(low - np.cumsum(n) + n, n)
        pair = (at[both], rank[both]), (here, there)
        for out, (p, q) in zip((cuts, links), pair):
            out.append((q, p) if swap else (p, q))
    (ca, cb), (la, lb) = (tuple(map(np.concatenate, zip(*x))) for x in (cuts, links))
    order = np.argsort(ca, kind="stable")
    return ca[order], cb[order], la, lb


@dataclass
class Vocabulary:
    """Bytes of all tokens, one after another, and their decimal ids in five places."""

    text: np.ndarray
    first: np.ndarray
    digits: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> Vocabulary:
        digits = np.array([str(i) for i in range(len(raw))], "S5").view(np.uint8).reshape(-1, 5)
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), digits)


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers. A is a byte-level BPE file of the tokenizers library,
    given a space and the text; B a SentencePiece model, which adds the space.

    Tokens of either never span a space between two characters that are no white
    space, save as their first byte, so a text is cut before such spaces and each
    distinct chunk of a slice is encoded once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_letters()
        n = self.a.get_vocab_size()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        words = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_vocabulary = Vocabulary.of([w.encode() if w in special else bytes(letters[c] for c in w) for w in words])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte0 = self.b.piece_to_id("<0x00>")
        self.b_vocabulary = Vocabulary.of([
            bytes([i - byte0]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])

    def __call__(self, column: pa.Array) -> tuple[Side, Side]:
        """Tokens of all texts; none of a text that is null, empty or not spelled by both."""
        data, off = flat(column)
        filled = off[:-1] < off[1:]
        data = np.insert(data, off[:-1][filled], 32)
        off = off + np.append(0, np.cumsum(filled))
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            cut[1:-1] = (data[1:-1] == 32) & ~SPACE[data[:-2]] & _STARTS_WORD[data[2:]]
        cut[off[:-1][filled]] = True
        first = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(first.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        which, texts = chunks.indices.to_numpy().astype(np.int64), chunks.dictionary.to_pylist()
        got = self.a.encode_batch_fast(texts, add_special_tokens=False)
        lists = [e.ids for e in got], self.b.encode([t[1:] for t in texts], num_threads=1)
        sides, fine = [], np.ones(len(texts), bool)
        raw, at = flat(chunks.dictionary)
        for ids, v in zip(lists, (self.a_vocabulary, self.b_vocabulary)):
            begin = np.cumsum([0, *map(len, ids)])
            ids = np.fromiter((i for x in ids for i in x), np.int64, int(begin[-1]))
            size = np.append(0, np.cumsum(v.first[ids + 1] - v.first[ids]))[begin]
            same = np.diff(size) == np.diff(at)
            if same.all():
                differ = np.append(0, np.cumsum(v.text[take(v.first, ids)] != raw))
                same = differ[at[:-1]] == differ[at[1:]]
            else:
                spelled = v.text[take(v.first, ids)]
                same = np.array([spelled[p:q].tobytes() == raw[r:s].tobytes() for p, q, r, s in zip(size, size[1:], at, at[1:])])
            fine &= same
            sides.append((ids, begin, v))
        # A text with a chunk that either spells otherwise has no tokens.
        doc = np.searchsorted(off, first[:-1], "right") - 1
        good = np.ones(len(off) - 1, bool)
        good[doc[~fine[which]]] = False
        which, doc = which[good[doc]], doc[good[doc]]
        out = []
        for ids, begin, v in sides:
            own = ids[take(begin, which)]
            n = np.bincount(doc, (begin[1:] - begin[:-1])[which], len(off) - 1).astype(np.int64)
            out.append(Side(own, np.append(0, np.cumsum(n)), np.cumsum(v.first[own + 1] - v.first[own])))
        return out[0], out[1]


@lru_cache(1)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def per_text(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the ascending places fall into each text, as offsets."""
    return np.searchsorted(places, first)


def group_texts(p: Pair, a: Side, b: Side, ca: np.ndarray, cb: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of each text, one after another, each with a `;` at
    its end, and where each begins."""
    n_a, n_b = len(a.ids), len(b.ids)
    ends_a, ends_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
    ends_a[ca], ends_b[cb] = True, True
    # A token of A comes after B's tokens of the groups before, one of B after A's up to its own group's end.
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    at_a = np.arange(n_a) + np.append(0, cb + 1)[group_a]
    at_b = np.arange(n_b) + (ca + 1)[group_b]
    rows = np.zeros((n_a + n_b, 6), np.uint8)
    rows[at_a, :5], rows[at_b, :5] = p.a_vocabulary.digits[a.ids], p.b_vocabulary.digits[b.ids]
    rows[at_a, 5], rows[at_b, 5] = np.where(ends_a, ord("|"), ord(",")), np.where(ends_b, ord(";"), ord(","))
    size = np.append(0, np.cumsum((rows != 0).sum(axis=1)))
    return rows[rows != 0].tobytes(), size[a.first + b.first]


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """All columns, with the ids of both tokenizers (a_ids, b_ids) and the place
    after the last token of each group in either (a_cuts, b_cuts), arrays of
    int; columns of those names are replaced. A text that is null, empty or not
    spelled by both has empty arrays. No shuffle; rows stay in place."""
    small_batches(docs)
    names = ("a_ids", "b_ids", "a_cuts", "b_cuts")
    docs = docs.drop(*names)
    out = T.StructType([*docs.schema, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])

    def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair_of(a_path, b_path)
        for batch in batches:
            for part in texts_of(batch, SLICE, text_col):
                a, b = p(part.column(text_col))
                ca, cb, _, _ = aligned(a, b)
                at = per_text(a.first, ca)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, lists(a.ids, a.first), lists(b.ids, b.first),
                    lists(ca + 1 - np.repeat(a.first[:-1], n), at), lists(cb + 1 - np.repeat(b.first[:-1], n), at)], names=out.names)

    return docs.mapInArrow(run, out)


def _packs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pack_id, pairs, counts, body): distinct id pairs of a pack as sorted
    32-bit values (A's id, then 15 bits of B's) with the number of its documents
    that hold each, and its documents' rows. Written, so that all stages agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair_of(a_path, b_path)
        base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row() -> pa.RecordBatch:
            pairs = np.concatenate([h[1] for h in held])
            distinct, place, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            tables, done = [], 0
            for columns, own, first, times in held:
                mine = place[done : done + len(own)]
                done += len(own)
                lists = [gaps(mine[x:y]) for x, y in zip(first.tolist(), first[1:].tolist())]
                often = times.astype("<u4").tobytes()
                often = [often[4 * x : 4 * y] for x, y in zip(first.tolist(), first[1:].tolist())]
                tables.append(pa.RecordBatch.from_arrays([*columns.columns, pa.array(lists, pa.binary()), pa.array(often, pa.binary())], names=[*columns.schema.names, "places", "times"]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for t in tables:
                    w.write_batch(t)
            return pa.RecordBatch.from_arrays([
                pa.array([base + k]), pa.array([distinct.astype("<u4").tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack_id", "pairs", "counts", "body"])

        for batch in batches:
            for part in texts_of(batch, SLICE):
                a, b = p(part.column("text"))
                ca, cb, la, lb = aligned(a, b)
                groups, at = group_texts(p, a, b, ca, cb)
                sha = [hashlib.sha256(groups[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at.tolist(), at[1:].tolist())]
                doc = np.searchsorted(a.first, la, "right") - 1
                links = np.bincount(doc, minlength=len(sha))
                code, times = np.unique(doc << 31 | a.ids[la] << 15 | b.ids[lb], return_counts=True)
                first = np.searchsorted(code >> 31, np.arange(len(sha) + 1))
                columns = pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(a.first)), pa.array(np.diff(b.first)), pa.array(np.diff(per_text(a.first, ca))), pa.array(links), pa.array(sha, pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                held.append((columns, (code & 0x7FFFFFFF).astype(np.uint32), first, times))
                size += int(flat(part.column("text"))[1][-1])
                if size >= PACK_BYTES:
                    yield row()
                    k, held, size = k + 1, [], 0
        if held:
            yield row()

    return settle(docs.mapInArrow(run, "pack_id long, pairs binary, counts binary, body binary"), "packs")


def link_counts(packs: DataFrame) -> DataFrame:
    """(pack_id, pair, n): a row per distinct pair of a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs = np.frombuffer(batch.column("pairs")[i].as_py(), "<u4").astype(np.int32)
                n = np.frombuffer(batch.column("counts")[i].as_py(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column("pack_id")[i].as_py())), pa.array(pairs), pa.array(n)], names=["pack_id", "pair", "n"])

    return packs.select("pack_id", "pairs", "counts").mapInArrow(run, "pack_id long, pair int, n long")


def link_stats(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links,
    groups_sha256 (of `a1,a2|b1;a3|b2,b3`; empty without tokens), n_best (links
    whose pair is in as many documents as any pair of its A id) and count_sum
    (documents of the pair, summed over links).

    A text that is null, empty or not spelled by both has zeros. Rows of the same
    id or text each count as a document; a null id stays null. Other columns are
    not read. Ids of A must be below 65536, those of B below 32768.

    Pairs are shuffled once per pack and pair; a pair that is everywhere has a
    row per pack, its sum is combined before the shuffle. The best of an A id is
    a window over the distinct pairs of that id, at most one per entry of B's
    vocabulary. Then a pack meets the counts of its own pairs in one task.
    """
    small_batches(docs)
    packs = _packs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), a_path, b_path)
    entries = link_counts(packs)
    total = entries.groupBy("pair").agg(F.sum("n").alias("total"))
    best = F.max("total").over(Window.partitionBy(F.shiftright("pair", 15)))
    total = settle(total.select("pair", "total", (F.col("total") == best).alias("best")), "links")
    answers = entries.select("pack_id", "pair").join(total.hint("merge"), "pair")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        n, best = right.column("total").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        out = []
        with pa.ipc.open_stream(pa.py_buffer(left.column("body")[0].as_py())) as parts:
            for part in parts:
                place, first = _ungapped(part.column("places"))
                times = np.frombuffer(flat(part.column("times"))[0].tobytes(), "<u4").astype(np.int64)
                sums = [np.append(0, np.cumsum(x[place] * times))[first] for x in (n, best)]
                out.append(pa.RecordBatch.from_arrays([*part.columns[:-2], *[pa.array(np.diff(s)) for s in sums]], names=[*part.schema.names[:-2], "count_sum", "n_best"]))
        return pa.Table.from_batches(out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long"
    return packs.select("pack_id", "body").groupBy("pack_id").cogroup(answers.groupBy("pack_id")).applyInArrow(each, schema)


def _ungapped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values that `gaps` wrote for each row, and where each row's begin."""
    raw, off = flat(column)
    d = np.frombuffer(raw.tobytes(), np.uint16).astype(np.int64)
    real = d != 65535
    off = off // 2
    total = np.append(0, np.cumsum(d))
    values = total[1:] - np.repeat(total[off[:-1]], np.diff(off))
    return values[real], np.append(0, np.cumsum(real))[off]
