"""Repeated byte strings, by longest-previous-factor arrays of suffix order.

Equal strings of `length` bytes have the same smallest gram hash, so all their
places can be brought together by it:

1. Every document's windows of `length` bytes fall into runs of the same
   smallest gram. Grams that occur at one place only are dropped, after an
   exchange of short hashes (packs.py).
2. A run of a gram that occurs elsewhere sends its context, the bytes of its
   windows, to the gram's bucket. Equal contexts leave a pack once and count as
   one in the bucket; what is left are the edges of repeats.
3. In a bucket, the suffixes at the window starts of different contexts are put
   in suffix order (to the depth of a window), with the common prefixes of
   neighbours. For each suffix, the nearest one in suffix order on either side
   that starts earlier in the corpus gives its longest previous factor, and the
   nearest that starts later its longest next one. A window repeats where
   these reach `length`.

A gram found in many packs doesn't meet in one bucket: its runs send a hash of
each window instead, which spread over all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import packs as P
from tidegrid.llm.text import BYTES, U, Rolling, flat, mix, runs, spread, sum_by, texts_of

GRAM = 64
BUCKET_BYTES = 4 << 20
#: Suffixes that are ordered at a time; more share their first eight bytes.
CHUNK = 1 << 16
#: A gram in more packs than this goes by window hashes.
HOT_PACKS = 500
_TOP = U((1 << 64) - 1)


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, by blocks of that width."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    m = np.append(h, np.full((-len(h)) % width + width, _TOP)).reshape(-1, width)
    left = np.minimum.accumulate(m, axis=1).ravel()
    right = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Contexts:
    """Runs of windows with the same smallest gram: start and number of windows,
    in bytes of the pack; gram value; hash of the context; whether the gram
    stands at several places of the run."""

    def __init__(self, batch: pa.RecordBatch, text_col: str, length: int):
        data, offs, parts, at = [], [np.zeros(1, np.int64)], [], 0
        for part in texts_of(batch, column=text_col):
            d, off = flat(part.column(text_col))
            parts.append(self._slice(d, off, length, at))
            data.append(d)
            offs.append(off[1:] + at)
            at += len(d)
        self.data = np.concatenate([np.zeros(0, np.uint8), *data])
        self.off = np.concatenate(offs)
        self.start, self.n, self.gram, self.hash, self.inner = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate((np.int64, np.int64, np.uint64, np.uint64, bool)))

    @staticmethod
    def _slice(data: np.ndarray, off: np.ndarray, length: int, base: int):
        roll = Rolling(BYTES[data])
        gram = min(GRAM, length)
        h = roll.windows(gram)
        low = smallest(h, length - gram + 1)
        n = np.maximum(0, np.diff(off) - length + 1)  # windows of each document
        ok = np.zeros(len(low) + 1, np.int32)
        np.add.at(ok, np.minimum(off[:-1], len(low)), n > 0)
        np.subtract.at(ok, np.minimum(off[:-1] + n, len(low)), n > 0)
        ok = np.cumsum(ok)[:-1] > 0
        first = np.zeros(len(low), bool)
        first[off[:-1][n > 0]] = True
        begin = ok & first
        begin[1:] |= ok[1:] & (low[1:] != low[:-1])
        start = np.flatnonzero(begin)
        close = np.ones(len(low), bool)
        close[:-1] = begin[1:] | ~ok[1:]
        stop = np.flatnonzero(ok & close) + 1
        again = sum_by(ok & (h[: len(low)] == low) & ~close, np.append(start, len(low))) > 0
        # Mixed, as smallest hashes are not spread evenly over the buckets.
        return start + base, stop - start, mix(low[start]), roll(start, stop + length - 1), again


def _distinct_contexts(c: Contexts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given runs the first of each context, by gram and hash; is it there again?"""
    order = which[np.lexsort((which, c.hash[which], c.gram[which]))]
    new = np.ones(len(order), bool)
    new[1:] = (c.hash[order[1:]] != c.hash[order[:-1]]) | (c.gram[order[1:]] != c.gram[order[:-1]])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))) > 1


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(start, size)]


def _nearest(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, its common prefix with the nearest one
    before it in that order that has a smaller place; 0 without one. lcp[i] is
    that of i - 1 and i. All suffixes follow their pointers at once, so the
    pointers' reach doubles."""
    near, common = np.arange(len(place)) - 1, lcp.copy()
    go = np.flatnonzero(near >= 0)
    go = go[place[near[go]] > place[go]]
    while len(go):
        via = near[go]
        common[go], near[go] = np.minimum(common[go], common[via]), near[via]
        go = go[near[go] >= 0]
        go = go[place[near[go]] > place[go]]
    return np.where(near >= 0, common, 0)


def factors(text: np.ndarray, starts: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor, up to depth, of the suffixes of
    `text` at `starts`, whose places in the corpus are `place`; each suffix has
    `depth` bytes. Factors below eight bytes may be given as 0."""
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)
    key = np.zeros(len(starts), U)
    for k in range(min(8, depth)):
        key = (key << U(8)) | text[starts + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    lpf, lnf = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    alone = np.diff(heads) == 1
    live = np.repeat(~alone, np.diff(heads))
    order, key = order[live], key[live]
    heads = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(key):
        hi = int(heads[max(np.searchsorted(heads, lo + CHUNK, "right") - 1, np.searchsorted(heads, lo, "right"))])
        own = order[lo:hi]
        part = rows[starts[own]]
        rank = np.argsort(part.view(f"S{depth}").ravel(), kind="stable")
        part, own = part[rank], own[rank]
        differ = part[1:] != part[:-1]
        lcp = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), depth))
        back = np.append(0, lcp[:0:-1])
        for out, p in ((lpf, place[own]), (lnf, -place[own])):
            out[own] = np.maximum(_nearest(p, lcp), _nearest(p[::-1], back)[::-1])
        lo = hi
    return lpf, lnf


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def repeats(docs: DataFrame, length: int = 200, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False,
            pack_bytes: int = P.PACK_BYTES, hot_packs: int = HOT_PACKS) -> DataFrame:
    """Bytes covered by a string of `length` bytes that also starts anywhere
    else, in the same or another row; overlaps count.

    Returns one row per input row: the id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 of the bytes left, spans (array of byte ranges
    [start, end)) and, with `with_kept`, those bytes (binary). All copies go;
    with keep_first, the earliest in the order in which the input is read
    stays. Strings are judged on the input. A null text is empty; a null id
    stays null; a repeated row repeats its strings; nothing gives nothing.
    length is 16 or more."""
    if length < 16:
        raise ValueError("length must be 16 or more")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = docs.schema
    held = P.packed(docs, pack_bytes=pack_bytes)
    bits = P.bucket_bits(held, BUCKET_BYTES)
    shift = U(64 - bits - 24)

    def rows_of(pack: int, named: dict[str, list]) -> pa.Table:
        use = [i for i in range(1 << bits) if any(v[i] for v in named.values())]
        return pa.table({"bucket": pa.array(use, pa.int32()), "pack_id": pa.array([pack] * len(use), pa.int64()), **{k: pa.array([v[i] for i in use], pa.binary()) for k, v in named.items()}})

    def cut(values: np.ndarray, last: bool) -> list[tuple[int, int]]:
        b = P.by_bucket(values << shift if last else values, bits)
        return list(zip(b, b[1:]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, body in zip(batch.column("pack_id").to_pylist(), batch.column("body")):
                c = Contexts(P.unpack(body), "text", length)
                values, n = np.unique(c.gram >> shift, return_counts=True)
                twice = np.union1d(values[n > 1], np.unique(c.gram[c.inner] >> shift))
                yield from rows_of(pack, {k: [P.gaps(v[a:b] & U(0xFFFFFF)) for a, b in cut(v, True)] for k, v in (("grams", values), ("twice", twice))}).to_batches()

    def live(rows: pa.Table) -> pa.Table:
        seen, double = np.zeros(1 << 24, np.uint16), np.zeros(1 << 24, bool)
        got = [P.ungaps(x.as_py()) for x in rows.column("grams")]
        for v in got:
            seen[v] = np.minimum(seen[v], 65534) + 1
        for x in rows.column("twice"):
            double[P.ungaps(x.as_py())] = True
        hot, some = seen > hot_packs, double | (seen > 1)
        return pa.table({"bucket": rows.column("bucket"), "pack_id": rows.column("pack_id"), "live": pa.array([P.gaps(v[some[v]]) for v in got], pa.binary()), "hot": pa.array([P.gaps(v[hot[v]]) for v in got], pa.binary())})

    found = P.exchange(held.mapInArrow(probe, "bucket int, pack_id long, grams binary, twice binary"), live, "bucket int, pack_id long, live binary, hot binary")

    def values_of(answers: pa.Table, name: str) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, U), *(P.ungaps(x.as_py()).astype(U) + (U(b) << U(24)) for b, x in zip(answers.column("bucket").to_pylist(), answers.column(name)))]))

    def window_hashes(c: Contexts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of runs, in the order of the pack."""
        at = np.repeat(c.start[which], c.n[which]) + np.arange(int(c.n[which].sum())) - np.repeat(np.cumsum(c.n[which]) - c.n[which], c.n[which])
        return at, Rolling(BYTES[c.data])(at, at + length) if len(at) else np.zeros(0, U)

    def send(batch: pa.RecordBatch, answers: pa.Table, pack: int) -> pa.Table:
        c = Contexts(batch, "text", length)
        is_hot = _in(values_of(answers, "hot"), c.gram >> shift)
        own, again = _distinct_contexts(c, np.flatnonzero(_in(values_of(answers, "live"), c.gram >> shift) & ~is_hot))
        press, named = zstandard.ZstdCompressor(1), {k: [] for k in ("head", "body", "windows")}
        for a, b in cut(c.gram[own], False):
            r = own[a:b]
            head = np.column_stack([c.gram[r], c.hash[r], c.start[r].astype(U), c.n[r].astype(U), again[a:b].astype(U) + U(2) * c.inner[r].astype(U)])
            named["head"].append(head.tobytes())
            named["body"].append(press.compress(_pieces(c.data, c.start[r], c.n[r] + length - 1).tobytes()) if len(r) else b"")
        v = np.unique(window_hashes(c, np.flatnonzero(is_hot))[1])
        named["windows"] = [v[a:b].tobytes() for a, b in cut(v, False)]
        return rows_of(pack, named)

    def judge(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("pack_id").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        unpress = zstandard.ZstdDecompressor()
        heads = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 5) for x in rows.column("head")]
        text = np.frombuffer(b"".join(unpress.decompress(x.as_py()) if len(x.as_py()) else b"" for x in rows.column("body")), np.uint8)
        head = np.concatenate(heads)
        n = head[:, 3].astype(np.int64)
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        # One of each context, the earliest: rows are in the order of packs.
        row = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        by = np.lexsort((head[:, 2], row, head[:, 1], head[:, 0]))
        new = np.ones(len(by), bool)
        new[1:] = (head[by[1:], 0] != head[by[:-1], 0]) | (head[by[1:], 1] != head[by[:-1], 1])
        group = np.cumsum(new) - 1
        one = by[new]
        copies = np.bincount(group, minlength=len(one)) + (np.bincount(group, head[by, 4].astype(np.int64) & 1, len(one)) > 0)
        inner = np.bincount(group, head[by, 4].astype(np.int64) >> 1, len(one)) > 0
        gram = head[one, 0]
        fresh = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        crowd = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] if len(gram) else np.zeros(0, int)
        meet = np.flatnonzero((crowd > 1) | inner)
        meet = meet[np.lexsort((head[one[meet], 2], row[one[meet]]))]  # in the order of the corpus
        size = n[one[meet]]
        starts = np.repeat(begin[one[meet]], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        lpf, lnf = factors(text, starts, np.arange(len(starts)), length) if len(starts) else (starts, starts)
        hit = lpf >= length if keep_first else (lpf >= length) | (lnf >= length)
        # Answers, by context: a bit per window.
        width = n[one]
        first = np.cumsum(width) - width
        mask = np.zeros(int(width.sum()), bool)
        mask[np.repeat(first[meet], size) + starts - np.repeat(begin[one[meet]], size)] = hit
        whole = copies > 1 if not keep_first else np.zeros(len(one), bool)
        mask |= np.repeat(whole, width)
        bits_of: list[bytes] = []
        context = np.empty(len(by), np.int64)
        context[by] = group
        is_one = np.zeros(len(by), bool)
        is_one[one] = True
        for k, x in enumerate(np.split(np.arange(len(head)), np.cumsum([len(x) for x in heads])[:-1])) if len(heads) else []:
            got = _pieces(mask, first[context[x]], width[context[x]])
            if keep_first:  # a later copy of a whole context goes
                got = got | np.repeat(~is_one[x], width[context[x]])
            bits_of.append(np.packbits(got).tobytes())
        # Window hashes: those in other packs, or in an earlier one.
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("windows")]
        every = np.concatenate([np.zeros(0, U), *lists])
        at = np.argsort(every, kind="stable")
        same = np.zeros(len(every), bool)
        same[1:] = every[at[1:]] == every[at[:-1]]
        if not keep_first:
            same[:-1] |= same[1:]
        back = np.zeros(len(every), bool)
        back[at] = same
        cuts = np.cumsum([0, *map(len, lists)])
        return pa.table({"bucket": rows.column("bucket"), "pack_id": rows.column("pack_id"),
                         "contexts": pa.array([np.ascontiguousarray(x[:, [1, 3]]).tobytes() for x in heads], pa.binary()), "bits": pa.array(bits_of, pa.binary()),
                         "windows": pa.array([v[back[a:b]].tobytes() for v, a, b in zip(lists, cuts, cuts[1:])], pa.binary())})

    sent = P.told(held, found, send, "bucket int, pack_id long, head binary, body binary, windows binary")
    judged = P.exchange(sent, judge, "bucket int, pack_id long, contexts binary, bits binary, windows binary")
    hot = found.select("pack_id", "bucket", "hot").where("length(hot) > 0")
    judged = judged.unionByName(hot, allowMissingColumns=True)

    def finish(batch: pa.RecordBatch, answers: pa.Table, pack: int) -> pa.Table:
        c = Contexts(batch, "text", length)
        gone = np.zeros(len(c.data), bool)
        head, masks, windows = [np.zeros((0, 2), U)], [np.zeros(0, bool)], [np.zeros(0, U)]
        hot_rows = answers.filter(pa.compute.is_valid(answers.column("hot")))
        for ctx, raw, win in zip(*(answers.column(k).to_pylist() for k in ("contexts", "bits", "windows"))):
            if ctx:
                h = np.frombuffer(ctx, np.uint64).reshape(-1, 2)
                head.append(h)
                masks.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=int(h[:, 1].sum())).astype(bool))
            if win:
                windows.append(np.frombuffer(win, np.uint64))
        head, mask = np.concatenate(head), np.concatenate(masks)
        width = head[:, 1].astype(np.int64)
        first = np.cumsum(width) - width
        order = np.argsort(head[:, 0], kind="stable")
        known = head[order, 0]
        use = np.flatnonzero(_in(known, c.hash))
        if len(use):
            which = order[np.searchsorted(known, c.hash[use])]
            got = _pieces(mask, first[which], width[which])
            if keep_first:  # a later copy within the pack goes too
                _, where = np.unique(c.hash[use], return_index=True)
                later = np.ones(len(use), bool)
                later[where] = False
                got = got | np.repeat(later, width[which])
            at = np.repeat(c.start[use], width[which]) + np.arange(len(got)) - np.repeat(np.cumsum(width[which]) - width[which], width[which])
            gone[at] = got
        hot_runs = np.flatnonzero(_in(values_of(hot_rows, "hot"), c.gram >> shift))
        if len(hot_runs):
            at, h = window_hashes(c, hot_runs)
            order = np.argsort(h, kind="stable")
            same = np.zeros(len(h), bool)
            same[1:] = h[order[1:]] == h[order[:-1]]
            if not keep_first:
                same[:-1] |= same[1:]
            inside = np.zeros(len(h), bool)
            inside[order] = same
            gone[at] = inside | _in(np.sort(np.concatenate(windows)), h)
        gone = spread(gone, length)
        begin, end, doc = runs(gone, c.off)
        pairs = pa.StructArray.from_arrays([pa.array(begin - c.off[doc]), pa.array(end - c.off[doc])], ["start", "end"])
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        left, n_gone = ~gone, sum_by(gone, c.off)
        kept = [c.data[a:b][left[a:b]].tobytes() if g else c.data[a:b].tobytes() for a, b, g in zip(c.off, c.off[1:], n_gone)]
        out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(c.off)), "n_removed": pa.array(n_gone), "n_spans": pa.array(np.diff(cuts).astype(np.int64)),
               "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "spans": pa.ListArray.from_arrays(pa.array(cuts), pairs)}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([fields["doc_id"], *[T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)])
    out = out.add("kept", T.BinaryType()) if with_kept else out
    return P.told(held, judged, finish, out).withColumnRenamed("doc_id", id_col)
