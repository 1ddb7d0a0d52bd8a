"""Token ids in a binary file format: canonical Huffman codes of limited length.

Ids come from a public tokenizer; each
distinct word of a task is encoded once. Code lengths follow the counts of all ids. A file is a Parquet table of
rows in document order, so that Spark's writer commits it and any store serves
it; a row holds the bits of some documents, with
  block checkpoints: the bit at which each block of BLOCK ids begins, so blocks
  decode on their own, and
  a directory: the ids of the documents and their token counts.
The code book is a table of (id, length); codes follow from the lengths.

Decoding looks up the next MAX_LENGTH bits in one table, for all blocks of a
row at once: a step decodes one id of every block.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.text import BYTES, U, Words, flat, range_hashes, small_batches, texts_of
from tidegrid.session import settle

MAX_LENGTH, BLOCK = 16, 512
SLICE = 1 << 19


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Classes of bytes for cutting words: letters of ASCII, the lead and the second
# byte of the letters U+00C0 to U+00FF, ASCII punctuation that is no part of a
# contraction or special token, and all others.
_OTHER, _LETTER, _PUNCT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[list(b".,;:!?-()\"")] = _PUNCT


def _atoms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into strings that the tokenizer treats on their own: words, of
    which those that are letters and then punctuation (in ASCII and Latin-1)
    are cut there and lower-cased, as the tokenizer does itself. Returns the
    bytes, start and end of each, and the first of each row."""
    w = Words(data, off)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    back = np.zeros(len(data), bool)  # where a letter follows punctuation
    back[1:] = (kind[1:] == _LETTER) & (kind[:-1] == _PUNCT)
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum((kind == _OTHER) | back, out=odd[1:])
    plain = (odd[w.end] == odd[w.start]) | ((odd[w.end] - odd[w.start] == 1) & back[w.start])
    step = np.zeros(len(data) + 1, np.int8)
    step[w.start[plain]] += 1
    step[w.end[plain]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    low = data.copy()
    upper = inside & (data >= 65) & (data <= 90)
    accent = lead[inside[lead]] + 1
    accent = accent[data[accent] <= 0x9E]
    low[upper] += 32
    low[accent] += 32
    cut = np.zeros(len(data), bool)
    cut[1:] = inside[1:] & (kind[1:] == _PUNCT) & (kind[:-1] == _LETTER)
    cut[w.start] = False
    at = np.flatnonzero(cut)
    start, end = np.sort(np.concatenate([w.start, at])), np.sort(np.concatenate([w.end, at]))
    return low, start, end, np.searchsorted(start, off)


class Encoder:
    """Ids of texts; each distinct string that stands alone is encoded once."""

    KEEP = 500_000
    LETTERS = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        self.tok, self.known = tokenizer(path), {}
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # How the tokenizer spells a letter to its model.
        self.spelled = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if self.LETTERS.fullmatch(c)}

    def _learn(self, atoms: list[tuple[int, str]]) -> None:
        """Words of letters go to the model at once, all others through the whole
        tokenizer, in long lists, as a call costs more than a word."""
        model, rest = self.tok.model, []
        for key, x in atoms:
            if self.LETTERS.fullmatch(x):
                self.known[key] = np.array([t.id for t in model.tokenize(x.translate(self.spelled))], self.type).tobytes()
            else:
                rest.append((key, x))
        for a in range(0, len(rest), 5000):
            part = rest[a : a + 5000]
            e = self.tok.encode([x for _, x in part], is_pretokenized=True, add_special_tokens=False)
            cuts = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            ids, size = np.array(e.ids, self.type).tobytes(), self.type.itemsize
            for (key, _), lo, hi in zip(part, cuts, cuts[1:]):
                self.known[key] = ids[size * lo : size * hi]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin."""
        data, start, end, first_atom = _atoms(*flat(column))
        # Atoms and what stands between them, in turn, as one string array.
        bounds = np.empty(2 * len(start), np.int64)
        bounds[::2], bounds[1::2] = start, end
        both = pa.Array.from_buffers(pa.large_string(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
        coded = both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        back, (raw, at) = coded.indices.to_numpy(), flat(coded.dictionary)
        keys = range_hashes(BYTES[raw], raw, at[:-1], at[1:]).tolist()
        lists = [self.known.get(k) for k in keys]
        new = [i for i, x in enumerate(lists) if x is None]
        if len(self.known) + len(new) > self.KEEP:
            self.known, new = {}, range(len(keys))
        text = raw.tobytes()
        self._learn([(keys[i], text[at[i] : at[i + 1]].decode()) for i in new])
        for i in new:
            lists[i] = self.known[keys[i]]
        n = np.fromiter(map(len, lists), np.int64, len(lists)) // self.type.itemsize
        ids = np.frombuffer(b"".join(lists), self.type)
        first = np.append(0, np.cumsum(n))
        size = n[back]
        begin = np.cumsum(size) - size
        out = ids[np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(first[back], size)].astype(np.int64)
        return out, np.append(begin, len(out))[first_atom]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, with the words that it knows by then."""
    return Encoder(path)


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """end_id after each document."""
    return np.insert(ids, first[1:], end_id), first + np.arange(len(first))


def code_lengths(counts: dict[int, int], limit: int = MAX_LENGTH) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge:
    pair up the cheapest, add the leaves again, limit - 1 times; a leaf's length
    is how often it is among the first 2n - 2."""
    leaves = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(leaves) > 1 << limit:
        raise ValueError(f"{len(leaves)} ids don't fit codes of {limit} bits")
    if len(leaves) < 2:
        return {i: 1 for _, i in leaves}
    weight = np.array([n for n, _ in leaves], np.int64)
    # Each level: sorted weights, and how many of a prefix are leaves.
    levels, now = [], weight
    is_leaf = np.ones(len(weight), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        now, is_leaf = both[order], order < len(weight)
    levels.append(is_leaf)
    length, take = np.zeros(len(weight), np.int64), 2 * len(weight) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    return {i: int(x) for (_, i), x in zip(leaves, length)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in code order (by length, then id) and their lengths."""
    pairs = sorted((n, i) for i, n in lengths.items())
    return np.array([i for _, i in pairs], np.int64), np.array([n for n, _ in pairs], np.int64)


class Book:
    """Codes, and the table of MAX_LENGTH bits that decodes them."""

    def __init__(self, lengths: dict[int, int]):
        ids, n = canonical(lengths)
        span = 1 << (MAX_LENGTH - n)
        begin = np.cumsum(span) - span
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[ids], self.length[ids] = (begin >> (MAX_LENGTH - n)).astype(np.uint64), n
        self.symbol, self.step = np.zeros(1 << MAX_LENGTH, np.int64), np.ones(1 << MAX_LENGTH, np.int64)
        self.symbol[: span.sum()], self.step[: span.sum()] = np.repeat(ids, span), np.repeat(n, span)

    def write(self, ids: np.ndarray, first: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """For each document its bits, which fill whole 32-bit words, and the bit
        at which each of its blocks begins."""
        n = self.length[ids]
        ends = np.append(0, np.cumsum(n))
        words = -(-(ends[first[1:]] - ends[first[:-1]]) // 32)
        base = np.append(0, np.cumsum(words))
        own = ends[:-1] - np.repeat(ends[first[:-1]], np.diff(first))  # bit within the document
        at = own + np.repeat(base[:-1] * 32, np.diff(first))
        word = at >> 5
        value = self.code[ids] << (64 - n - (at & 31)).astype(U)  # in the 64 bits from that word on
        size = int(base[-1]) + 1
        high = np.bincount(word, (value >> U(32)).astype(np.float64), size)  # no two codes share a bit: sums are unions
        high[1:] += np.bincount(word, (value & U(0xFFFFFFFF)).astype(np.float64), size)[:-1]
        raw = high.astype(np.uint32).astype(">u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(base.tolist(), base[1:].tolist())], [own[a:b:BLOCK] for a, b in zip(first.tolist(), first[1:].tolist())]

    def read(self, bits: list[bytes], starts: list[np.ndarray], n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each one's begin."""
        first = np.append(0, np.cumsum(n_ids))
        size = np.array([len(b) for b in bits], np.int64)
        base = (np.cumsum(size) - size) * 8
        blocks = np.array([len(x) for x in starts], np.int64)
        doc = np.repeat(np.arange(len(bits)), blocks)
        begin = np.concatenate([np.zeros(0, np.int64), *starts]) + base[doc]
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        out_at = first[doc] + k * BLOCK
        left = np.minimum(BLOCK, n_ids[doc] - k * BLOCK)
        raw = np.frombuffer(b"".join(bits) + bytes(4), np.uint8).astype(np.uint32)
        window = ((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]).astype(np.int64)
        out = np.zeros(int(first[-1]), np.int64)
        order = np.argsort(-left, kind="stable")  # blocks that end drop off at the end
        at, out_at, left = begin[order], out_at[order], left[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # those with more than `step` ids
            at, out_at = at[:live], out_at[:live]
            look = (window[at >> 3] >> (8 - (at & 7))) & 0xFFFF
            out[out_at + step] = self.symbol[look]
            at = at + self.step[look]
        return out, first


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids of each text and the end id, as packed unsigned
    integers of two or four bytes; written, as two passes read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in texts_of(batch, SLICE):
                ids, first = with_end(*encode(part.column("text")), end_id)
                raw, size = ids.astype(encode.type).tobytes(), encode.type.itemsize
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([raw[size * a : size * b] for a, b in zip(first.tolist(), first[1:].tolist())], pa.binary())], names=["doc_id", "ids"])

    return settle(docs.mapInArrow(run, "doc_id long, ids binary"), "ids")


def _unpack(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw, off = flat(column)
    return np.frombuffer(raw.tobytes(), dtype).astype(np.int64), off // dtype.itemsize


def count_ids(rows: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, n): one row per task and id is shuffled, never an id per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_unpack(batch.column("ids"), dtype)[0])
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_CODED = "doc_id long, n_ids long, crc32 long, bits binary, starts array<long>"


def _crc(ids: np.ndarray, first: np.ndarray) -> list[int]:
    raw = ids.astype("<u4").tobytes()
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), first[1:].tolist())]


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null is empty), append end_id, and write the ids in
    ascending order of the document id to `out`: `out/book` and `out/rows`.

    Rows with a null id come first; equal ids stand side by side; other columns
    are not read. `path` names the tokenizer's file, the same on every machine.
    No documents give an empty table. Bits, not texts or ids, are sorted."""
    small_batches(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    ids, dtype = encoded(docs, path, end_id), encoder(path).type
    counts = {r["id"]: r["n"] for r in count_ids(ids, dtype).collect()}  # one row per entry of the vocabulary at most
    lengths = code_lengths(counts)
    spark.createDataFrame(sorted(lengths.items()), "id long, length long").coalesce(1).write.parquet(os.path.join(out, "book"))
    sent = spark.sparkContext.broadcast(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(sent.value)
        for batch in batches:
            for part in texts_of(batch, SLICE, "ids"):
                own, first = _unpack(part.column("ids"), dtype)
                bits, starts = book.write(own, first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(_crc(own, first), pa.int64()), pa.array(bits, pa.binary()), pa.array(starts, pa.list_(pa.int64()))], names=["doc_id", "n_ids", "crc32", "bits", "starts"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_ids").to_numpy()
            own = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(n), pa.int64()), pa.array(own), *batch.columns], names=["file", "before", *batch.schema.names])

    ordered = ids.mapInArrow(code, _CODED).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(place, f"file long, before long, {_CODED}").write.parquet(os.path.join(out, "rows"))


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids and
    ids_crc32 of every document in the files. Ids that don't match the checksum
    written with them raise an error."""
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(os.path.join(out, "book")).collect()}  # bounded by the vocabulary
    sent = spark.sparkContext.broadcast(lengths)
    rows = spark.read.parquet(os.path.join(out, "rows"))
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row per file
    first = files.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(sent.value)
        for batch in batches:
            n = batch.column("n_ids").to_numpy()
            starts = batch.column("starts")
            lists = np.split(starts.flatten().to_numpy(), np.cumsum(starts.value_lengths().to_numpy())[:-1])
            ids, at = book.read([b.as_py() for b in batch.column("bits")], lists, n)
            crc = _crc(ids, at)
            if crc != batch.column("crc32").to_pylist():
                raise ValueError("ids read differ from the ids written")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("before"), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(crc, pa.int64())], names=["doc_id", "file", "before", "n_tokens", "ids", "ids_crc32"])

    read = rows.mapInArrow(decode, "doc_id long, file long, before long, n_tokens long, ids array<int>, ids_crc32 long")
    return read.join(first, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids", "ids_crc32")
