"""Language of a text: averaged embeddings of hashed subwords and a linear
softmax, trained by stochastic gradient descent, with calibrated rejection.

A subword is a run of 2 to 4 bytes in which white space stands at the ends
only (it marks where words begin and end). A text is the mean of the vectors of
its subwords' buckets. Training takes a bounded sample of labelled documents;
what is fitted (buckets by dimensions, dimensions by languages) doesn't grow
with the corpus, and is folded to one number per bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.text import LOWER, SPACE, U, flat, small_batches, texts_of

BUCKET_BITS, SIZES, DIM = 14, (2, 3, 4), 16
#: At most this many documents are sampled for training, dealt evenly over the
#: languages, but MIN_PER_LANGUAGE of each. A document's share is its bucket
#: counts, 2**BUCKET_BITS at most.
TRAIN_DOCS, MIN_PER_LANGUAGE = 1200, 20
EPOCHS, BATCH, RATE = 30, 32, 2.0
#: Scores are calibrated on this share of the sample, and a prediction is
#: rejected below the score that all but 1 in 100 of its right ones reach.
HELD_BACK, REJECT_SHARE = 0.25, 0.01
_ROWS = 128


def _counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents by buckets: how often each occurs."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    space = SPACE[data]
    b = LOWER[data].astype(U)
    b[space] = 32
    out = np.zeros(n << BUCKET_BITS, np.int64)
    for size in SIZES:
        m = len(data) - size + 1
        if m <= 0:
            break
        ok = doc[:m] == doc[size - 1 :]
        gram = np.full(m, size, U)
        for k in range(size):
            gram = (gram << U(8)) | b[k : k + m]
            if 0 < k < size - 1:
                ok &= ~space[k : k + m]
        ok &= ~(space[:m] & space[size - 1 :])
        bucket = (gram[ok] * U(0x9E3779B97F4A7C15)) >> U(64 - BUCKET_BITS)
        out += np.bincount((doc[:m][ok] << BUCKET_BITS) + bucket.astype(np.int64), minlength=len(out))
    return out.reshape(n, -1)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets by languages, over the temperature
    bias: np.ndarray
    reject_below: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = counts @ self.table / np.maximum(1, counts.sum(axis=1, keepdims=True)) + self.bias
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 3) -> LanguageModel:
    """x: documents by buckets, rows sum to 1; y: numbers of languages."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: int(HELD_BACK * len(x))], order[int(HELD_BACK * len(x)) :]
    emb, w, bias = rng.normal(0, 0.3, (x.shape[1], DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(own)
        for at in range(0, len(own), BATCH):
            rows = own[at : at + BATCH]
            xb = x[rows]
            h = xb @ emb
            g = _softmax(h @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            step_h = g @ w.T
            w -= rate * (h.T @ g)
            bias -= rate * g.sum(axis=0)
            emb -= rate * (xb.T @ step_h)
    if not len(held):
        held = own
    z, best = x[held] @ emb @ w + bias, None
    for t in np.geomspace(0.05, 10, 60):
        p = _softmax(z / t)
        loss = -np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = loss, t, p
    _, t, p = best
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return LanguageModel(langs, (emb @ w / t).astype(np.float64), (bias / t).astype(np.float64), float(np.quantile(right, REJECT_SHARE)) if len(right) else 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, cap: int = TRAIN_DOCS) -> LanguageModel | None:
    """Fit on a sample of the labelled documents: those with the smallest hash of
    `key`. Null labels and texts are left out; None without any label."""
    rows = docs.select(F.xxhash64(key if key is not None else F.col(text_col)).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(MIN_PER_LANGUAGE, cap // max(1, n.count()))
    # A share of each language with some to spare, then the first of those few.
    # Shares are one row per language, as many as the model has outputs.
    share = n.withColumn("below", F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("n")))
    near = rows.join(F.broadcast(share), "lang").where(F.expr("pmod(key, 1000000) < below * 1000000"))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("r") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch):
                for at in range(0, part.num_rows, _ROWS):
                    own = part.slice(at, _ROWS)
                    c = _counts(*flat(own.column("text")))
                    some = [np.flatnonzero(x) for x in c]
                    yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("r"), pa.array([s.astype(np.uint16).tobytes() for s in some], pa.binary()), pa.array([x[s].astype(np.uint32).tobytes() for x, s in zip(c, some)], pa.binary())], names=["lang", "r", "at", "n"])

    got = sorted(few.select("lang", "r", "text").mapInArrow(run, "lang string, r int, at binary, n binary").collect())
    got = [r for r in got if r["at"]]
    if not got:
        return None
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), 1 << BUCKET_BITS), np.float32)
    for row, r in zip(x, got):
        c = np.frombuffer(r["n"], np.uint32)
        row[np.frombuffer(r["at"], np.uint16)] = c / c.sum()
    return fit(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def _letterless(texts: list[str | None], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    some = np.zeros(len(data) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=some[1:])
    out = some[off[1:]] == some[off[:-1]]
    for i in np.flatnonzero(out & (np.diff(off) > 0)).tolist():
        out[i] = not any(map(str.isalpha, texts[i]))
    return out


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns, with lang_pred, score (0 to 1) and rejected (score below what
    the calibration asks); columns of those names are replaced.

    A null text, one without a letter, and any text without a model are `und`
    with score 0, rejected."""
    small_batches(docs)
    docs = docs.drop("lang_pred", "score", "rejected")
    out = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in texts_of(batch, column=text_col):
                for at in range(0, part.num_rows, _ROWS):
                    own = part.slice(at, _ROWS)
                    data, off = flat(own.column(text_col))
                    none = _letterless(own.column(text_col).to_pylist(), data, off)
                    if m is None:
                        none[:] = True
                    p = m.scores(_counts(data, off)) if m else np.zeros((own.num_rows, 1))
                    score = np.where(none, 0.0, p.max(axis=1))
                    lang = ["und" if x else m.langs[k] for x, k in zip(none.tolist(), p.argmax(axis=1).tolist())]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(none | (score < (m.reject_below if m else 1.0)))], names=out.names)

    return docs.mapInArrow(run, out)
