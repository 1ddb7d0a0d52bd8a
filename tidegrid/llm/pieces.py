"""Encoding to and decoding from the pieces of a SentencePiece BPE model, with
seeded merge dropout.

Encoding is the model's own agenda: of all adjacent pairs whose concatenation
is a piece, the one of the best score, leftmost at ties, is merged next. With
dropout p each candidate is skipped where a keyed hash says so. The key is
(seed, the document's id and content, the chunk's place in it and content,
where the candidate begins, is split and ends): each occurrence of a word is
segmented by itself, and a run repeats exactly. With p = 0 the ids equal the
library's.

A text is cut into chunks that no piece spans (before a run of spaces, around
characters that are in no piece). Equal chunks of a slice are encoded
once without dropout; an occurrence none of whose candidates is skipped there
has the same result, and only the others get an agenda of their own. All
agendas advance together, one merge per chunk and round, as array operations. A very long chunk uses a heap of its own.

Decoding concatenates pieces. A character without a piece, and a literal
U+2581 (which otherwise stands for a space), is written as its UTF-8 bytes,
so decoding gives the text back, byte by byte.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.text import U, Rolling, flat, mix, range_hashes, small_batches, texts_of

SPACE_MARK, LITERAL_MARK = 0x2581, 0x110001
LONG_CHUNK, SLICE = 64, 1 << 19
_NONE = np.int64(1 << 40)
_SLOT = U(0x9E3779B97F4A7C15)


@dataclass
class Model:
    char_id: dict[int, int]  # code point -> symbol; symbols from n_pieces on are characters that are no piece
    chars: np.ndarray  # sorted code points that occur in pieces
    char_sym: np.ndarray
    joins: np.ndarray  # does the character occur in a piece of two or more?
    bits: int  # log2 of the slots of the pair table
    pair: np.ndarray  # left << 20 | right by slot, or -1
    merged: np.ndarray
    rank: np.ndarray  # equal for equal scores
    n_pieces: int
    byte0: int  # id of byte 0
    text: np.ndarray  # bytes of all ids, one after another
    first: np.ndarray


@lru_cache(2)
def model(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    chars = sorted({c for p in plain for c in p})
    symbol = dict(plain)
    for c in chars:
        symbol.setdefault(c, n + len(symbol) - len(plain))
    _, rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
    rows = [(symbol[p[:k]] << 20 | symbol[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
    bits = (4 * len(rows)).bit_length()
    pair, merged = np.full((1 << bits) + len(rows), -1, np.int64), np.zeros((1 << bits) + len(rows), np.int32)
    for want, i in rows:
        at = (want * int(_SLOT) % (1 << 64)) >> (64 - bits)
        while pair[at] >= 0:
            at += 1
        pair[at], merged[at] = want, i
    many = {c for p in plain if len(p) > 1 for c in p}
    raw = [bytes([i - sp.piece_to_id("<0x00>")]) if sp.is_byte(i) else sp.id_to_piece(i).replace(chr(SPACE_MARK), " ").encode() if sp.id_to_piece(i) in plain else b"" for i in range(n)]
    return Model(
        {ord(c): symbol[c] for c in chars}, np.array([ord(c) for c in chars], np.uint32), np.array([symbol[c] for c in chars]), np.array([c in many for c in chars]),
        bits, pair, merged, rank[merged].astype(np.int64), n, sp.piece_to_id("<0x00>"), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


class _Dropout:
    """Is a candidate skipped? By a hash of its chunk's key and its place."""

    def __init__(self, p: float):
        self.p, self.limit = p, U(min(int(p * 2.0**64), (1 << 64) - 1))

    def __call__(self, key: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = (start.astype(U) << U(42)) ^ (split.astype(U) << U(21)) ^ end.astype(U)
        return mix(key ^ mix(place + U(1))) < self.limit


def _ranks(m: Model, drop: _Dropout | None, left: np.ndarray, right: np.ndarray, key: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (_NONE if it is no piece or is skipped), and the piece."""
    want = left.astype(np.int64) << 20 | right
    at = (want.astype(U) * _SLOT >> U(64 - m.bits)).astype(np.int64)
    found = m.pair[at]
    odd = np.flatnonzero((found != want) & (found >= 0))
    while len(odd):  # the next slots of a pair whose slot another one has taken
        at[odd] += 1
        found[odd] = m.pair[at[odd]]
        odd = odd[(found[odd] != want[odd]) & (found[odd] >= 0)]
    ok = found >= 0
    if drop and drop.p > 0:
        some = np.flatnonzero(ok)
        ok[some[drop(key[some], start[some], split[some], end[some])]] = False
    return np.where(ok, m.rank[at], _NONE), m.merged[at]


def _one_by_one(m: Model, drop: _Dropout | None, sym: np.ndarray, key: int) -> np.ndarray:
    """The agenda of one chunk as a heap."""
    n = len(sym)
    sym, prev, nxt = sym.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    end, heap = list(range(1, n + 1)), []

    def push(lefts: list[int]) -> None:
        a = np.array(lefts, np.int64)
        b = np.array([nxt[i] for i in lefts], np.int64)
        if len(a):
            r, merged = _ranks(m, drop, np.array([sym[i] for i in a]), np.array([sym[i] for i in b]), np.full(len(a), key, U), a, b, np.array([end[i] for i in b]))
            for i, j, x, s in zip(a.tolist(), b.tolist(), r.tolist(), merged.tolist()):
                if x < _NONE:
                    heapq.heappush(heap, (x, i, end[j], sym[i], s))

    push(list(range(n - 1)))
    while heap:
        _, i, stop, old, new = heapq.heappop(heap)
        j = nxt[i] if sym[i] == old else n  # a symbol that was merged away is -1
        if j >= n or end[j] != stop:
            continue
        sym[i], end[i], nxt[i], sym[j] = new, end[j], nxt[j], -1
        if nxt[i] < n:
            prev[nxt[i]] = i
        push([k for k in (prev[i], i) if k >= 0 and nxt[k] < n])
    return np.array([s for s in sym if s >= 0], np.int64)


def _agendas(m: Model, drop: _Dropout | None, sym: np.ndarray, first: np.ndarray, key: np.ndarray, tried: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all chunks, and where each chunk's begin. `tried` gets
    the candidates met: chunk, begin, split and end; none of a long chunk."""
    size = np.diff(first)
    own = np.repeat(np.arange(len(size)), size)
    out_sym, out_own, out_at = [], [], []
    for c in np.flatnonzero(size > LONG_CHUNK).tolist():
        got = _one_by_one(m, drop, sym[first[c] : first[c + 1]], int(key[c]))
        out_sym.append(got), out_own.append(np.full(len(got), c)), out_at.append(np.arange(len(got)))
    go = size[own] <= LONG_CHUNK
    own, start = own[go].astype(np.int32), (np.arange(len(sym)) - first[own])[go].astype(np.int32)
    sym, end = sym[go].astype(np.int32), start + 1
    last = np.ones(len(sym), bool)
    last[:-1] = own[1:] != own[:-1]
    # Of the pair that begins at a symbol: rank, then place (below 128); and its piece.
    score, merged = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)

    def fresh(at: np.ndarray) -> None:
        rank, merged[at] = _ranks(m, drop, sym[at], sym[at + 1], key[own[at]], start[at], start[at + 1], end[at + 1])
        score[at] = np.where(rank < _NONE, rank * 128 + start[at], _NONE)
        if tried is not None:
            at = at[rank < _NONE]
            tried.append((own[at], start[at], start[at + 1], end[at + 1]))

    fresh(np.flatnonzero(~last))
    while len(sym):
        head = np.flatnonzero(np.append(True, last[:-1]))
        best = np.repeat(np.minimum.reduceat(score, head), np.diff(np.append(head, len(sym))))
        keep = best < _NONE
        over = np.flatnonzero(~keep)
        out_sym.append(sym[over]), out_own.append(own[over]), out_at.append(start[over])
        at = np.flatnonzero((score == best) & keep)  # one in each chunk that goes on
        sym[at], end[at], last[at], score[at] = merged[at], end[at + 1], last[at + 1], _NONE
        keep[at + 1] = False
        stay = np.flatnonzero(keep)
        sym, own, start, end, last, score, merged = (x[stay] for x in (sym, own, start, end, last, score, merged))
        at = np.searchsorted(stay, at)
        before = at[at > 0] - 1
        fresh(np.concatenate([at[~last[at]], before[~last[before]]]))
    if not out_sym:
        return np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
    sym, own, at = map(np.concatenate, (out_sym, out_own, out_at))
    order = np.lexsort((at, own))
    return sym[order], np.searchsorted(own[order], np.arange(len(size) + 1))


def _take(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices of the elements of the given rows of a CSR index."""
    n = first[rows + 1] - first[rows]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)


def _varied(m: Model, drop: _Dropout, sym: np.ndarray, first: np.ndarray, some: np.ndarray, back: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols with dropout: of each distinct chunk without a skip, then
    of each occurrence that has one; where they begin; which are each
    occurrence's. `some` are first occurrences of the distinct chunks, `back`
    the distinct chunk and `key` the key of each occurrence."""
    size = np.diff(first)
    tried: list = []
    base, base_first = _agendas(m, None, sym[_take(first, some)], np.append(0, np.cumsum(size[some])), key[some], tried)
    own, start, split, end = map(np.concatenate, zip(*tried))
    order = np.argsort(own, kind="stable")
    start, split, end = start[order], split[order], end[order]
    at = np.searchsorted(own[order], np.arange(len(some) + 1))
    skips = size > LONG_CHUNK  # a long chunk always has an agenda of its own
    n = (at[1:] - at[:-1])[back]
    go = np.flatnonzero(n > 0)
    bounds = np.append(0, np.cumsum(n[go]))
    for a in range(0, len(go), 1 << 17):
        rows = go[a : a + (1 << 17)]
        c = _take(at, back[rows])
        bad = drop(np.repeat(key[rows], n[rows]), start[c], split[c], end[c])
        skips[rows] |= np.logical_or.reduceat(bad, bounds[a : a + len(rows)] - bounds[a])
    alone = np.flatnonzero(skips)
    got, got_first = _agendas(m, drop, sym[_take(first, alone)], np.append(0, np.cumsum(size[alone])), key[alone])
    which = back.copy()
    which[alone] = len(some) + np.arange(len(alone))
    return np.concatenate([base, got]), np.concatenate([base_first, got_first[1:] + len(base)]), which


def _encode(m: Model, drop: _Dropout | None, seed: int, data: np.ndarray, off: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, and where each document's begin. `ids`: a hash of each document's id."""
    lead = (data & 0xC0) != 0x80
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=seen[1:])
    off = seen[off]
    code[code == SPACE_MARK] = LITERAL_MARK
    code[code == 32] = SPACE_MARK
    filled = np.flatnonzero(np.diff(off) > 0)
    code = np.insert(code, off[filled], SPACE_MARK)  # the model's dummy prefix
    off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
    if not len(code):
        return np.zeros(0, np.int64), off
    at = np.minimum(np.searchsorted(m.chars, code), len(m.chars) - 1)
    known = m.chars[at] == code
    sym = np.where(known, m.char_sym[at], -1 - code.astype(np.int64))
    alone = ~(known & m.joins[at])
    mark = code == SPACE_MARK
    cut = alone.copy()
    cut[1:] |= alone[:-1] | (mark[1:] & ~mark[:-1])
    cut[off[:-1][off[:-1] < len(code)]] = True
    first = np.append(np.flatnonzero(cut), len(code))
    doc_first = np.searchsorted(first, off)
    h = range_hashes(mix(code.astype(U) + U(77)), code, first[:-1], first[1:])
    distinct, some, back = np.unique(h, return_index=True, return_inverse=True)
    if drop and drop.p > 0:
        doc = mix(Rolling(mix(code.astype(U) + U(77)))(off[:-1], off[1:]) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        if ids is not None:
            doc = mix(doc + ids)
        place = np.arange(len(h)) - np.repeat(doc_first[:-1], np.diff(doc_first))
        key = mix(h + mix(np.repeat(doc, np.diff(doc_first)) + mix(place.astype(U) + U(1))))
        got, got_first, back = _varied(m, drop, sym, first, some, back, key)
    else:
        elements = _take(first, some)
        got, got_first = _agendas(m, None, sym[elements], np.append(0, np.cumsum((first[1:] - first[:-1])[some])), distinct)
    # Symbols to ids; a character without a piece becomes its bytes.
    low = np.flatnonzero((got < 0) | (got >= m.n_pieces))
    if len(low):
        back_char = {s: c for c, s in m.char_id.items() if s >= m.n_pieces}
        spelled = {s: [m.byte0 + b for b in chr(SPACE_MARK if c == LITERAL_MARK else c).encode()] for s in np.unique(got[low]).tolist() for c in [back_char[s] if s >= 0 else -1 - s]}
        n = np.ones(len(got), np.int64)
        n[low] = [len(spelled[s]) for s in got[low].tolist()]
        new_first = np.append(0, np.cumsum(n))
        ids = np.repeat(got, n)
        ids[_take(new_first, low)] = [b for s in got[low].tolist() for b in spelled[s]]
        got, got_first = ids, new_first[got_first]
    ids = got[_take(got_first, back)]
    n = np.append(0, np.cumsum((got_first[1:] - got_first[:-1])[back]))
    return ids, n[doc_first]


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))


Batches = Iterator[pa.RecordBatch]


def _to_encode(docs: DataFrame, path: str, p: float, seed: int, text_col: str, ids_col: str, id_col: str) -> tuple[DataFrame, T.StructType, Callable[[Batches], Batches]]:
    """The rows with a key as their last column, the columns of the result, and the map from one to the other."""
    small_batches(docs)
    docs = docs.drop(ids_col, f"{ids_col}_crc32")
    out = T.StructType([*docs.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(f"{ids_col}_crc32", T.LongType())])
    key = f"__{uuid.uuid4().hex}"  # after all other columns

    def run(batches: Batches) -> Batches:
        m, drop = model(path), _Dropout(p)
        for batch in batches:
            for part in texts_of(batch, SLICE, text_col):
                ids, first = _encode(m, drop, seed, *flat(part.column(text_col)), part.column(key).to_numpy().view(U))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(ids, first), pa.array(crc, pa.int64())], names=out.names)

    return docs.withColumn(key, F.xxhash64(id_col)), out, run


def _to_decode(fields: T.StructType, path: str, ids_col: str, out_col: str) -> tuple[T.StructType, Callable[[Batches], Batches]]:
    """The columns of the result, and the map to it from rows of `fields`."""
    out = T.StructType([*fields, T.StructField(out_col, T.StringType())])

    def run(batches: Batches) -> Batches:
        m = model(path)
        for batch in batches:
            col = batch.column(ids_col)
            counts = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = col.flatten().to_numpy().astype(np.int64)
            at = np.append(0, np.cumsum(m.first[ids + 1] - m.first[ids]))[np.append(0, np.cumsum(counts))]
            text = m.text[_take(m.first, ids)]
            filled = at[:-1] < at[1:]
            keep = np.ones(len(text), bool)
            keep[at[:-1][filled]] = False  # the dummy prefix
            at = at - np.concatenate([[0], np.cumsum(filled)])
            strings = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(text[keep].tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, strings.cast(pa.string())], names=out.names)

    return out, run


def encode(docs: DataFrame, path: str, p: float = 0.1, seed: int = 1, text_col: str = "text", ids_col: str = "piece_ids", id_col: str = "doc_id") -> DataFrame:
    """All columns, with the piece ids of the text (array of int) and their
    unsigned crc32 as little-endian 32-bit integers (`<ids_col>_crc32`); columns
    of those names are replaced. `path` names the model file, the same on every
    machine. A null or empty text has no ids. Rows of the same id and text, and
    those of the same text without an id, get the same ids. No shuffle; rows
    stay in place."""
    keyed, out, run = _to_encode(docs, path, p, seed, text_col, ids_col, id_col)
    return keyed.mapInArrow(run, out)


def decode(rows: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """All columns, with the text of the ids; null or no ids give an empty text."""
    rows = rows.drop(out_col)
    out, run = _to_decode(rows.schema, path, ids_col, out_col)
    return rows.mapInArrow(run, out)


def encode_and_decode(docs: DataFrame, path: str, p: float = 0.1, seed: int = 1, text_col: str = "text", ids_col: str = "piece_ids", id_col: str = "doc_id", out_col: str = "decoded") -> DataFrame:
    """decode(encode(docs)) in one pass: a task has one Python worker with the
    model in it, not two, which an executor would keep after the stage. `out_col`
    is neither the text nor the id."""
    if out_col in (text_col, id_col):
        raise ValueError("the decoded text takes a column of its own")
    keyed, coded, there = _to_encode(docs.drop(out_col), path, p, seed, text_col, ids_col, id_col)
    out, back = _to_decode(coded, path, ids_col, out_col)
    return keyed.mapInArrow(lambda batches: back(there(batches)), out)
