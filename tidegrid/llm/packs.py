"""Packs of documents, and the exchange of hashes between them.

A pack is one row that holds some MB of documents, compressed. It is written
once; every later stage reads it back, so stages agree on what a pack holds,
however often a task runs. Stages talk in sorted lists of distinct hashes, cut
by hash into buckets: a value that a pack holds a million times leaves it once,
and no bucket grows with a group of copies beyond one entry per pack.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.text import U, Words, flat, small_batches, texts_of
from tidegrid.session import settle

PACK_BYTES = 1 << 21


def packed(docs: DataFrame, text_col: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack_id, n, body): all columns of the documents, n bytes of text (about
    pack_bytes); written."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack_id", "n", "body"])

        for batch in batches:
            for part in texts_of(batch, min(pack_bytes, 1 << 18), text_col):
                held.append(part)
                size += int(flat(part.column(text_col))[1][-1])
                if size >= pack_bytes:
                    yield row()
                    k, held, size = k + 1, [], 0
        if held:
            yield row()

    return settle(docs.mapInArrow(run, "pack_id long, n long, body binary"), "packs")


def unpack(body: pa.Array) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.py_buffer(body.as_py())).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def pack_words(batch: pa.RecordBatch, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a pack and the first word of each document."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for part in texts_of(batch, column=text_col):
        w = Words(*flat(part.column(text_col)))
        hashes.append(w.hashes())
        counts.append(w.counts)
    return np.concatenate([np.zeros(0, U), *hashes]), np.cumsum(np.concatenate(counts))


def bucket_bits(packs: DataFrame, bytes_each: int) -> int:
    """log2 of the number of buckets, in proportion to the text; 16 at least."""
    total = packs.agg(F.sum("n")).first()[0] or 0
    return max(4, math.ceil(math.log2(max(1, total / bytes_each))))


def by_bucket(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits buckets begins in sorted 64-bit values, and the end."""
    return np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(values)]


def gaps(values: np.ndarray) -> bytes:
    """Sorted distinct 24-bit values as 16-bit gaps; 65535 adds to the next."""
    d = np.diff(values.astype(np.int64), prepend=0)
    full = d // 65535
    out = np.full(int(len(d) + full.sum()), 65535, np.uint16)
    out[np.arange(len(d)) + np.cumsum(full)] = d % 65535
    return out.tobytes()


def ungaps(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, np.uint16).astype(np.int64)
    return np.cumsum(d)[d != 65535]


def exchange(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows with a bucket number, answered bucket by bucket; the answers are written."""
    return settle(sent.groupBy("bucket").applyInArrow(answer, schema), "answers")


def told(packs: DataFrame, answers: DataFrame, run: Callable[[pa.RecordBatch, pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """run(documents, answers to this pack, pack_id) for each pack."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(unpack(left.column("body")[0]), right, left.column("pack_id")[0].as_py())

    return packs.select("pack_id", "body").groupBy("pack_id").cogroup(answers.groupBy("pack_id")).applyInArrow(each, schema)
