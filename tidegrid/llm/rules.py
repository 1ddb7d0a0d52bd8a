"""Quality rules as a ledger of bits.

Every rule is measured and evaluated once per document; the ledger stores the
measurements and one bit per failed rule. A policy is a versioned mask over
those bits, so a verdict, another policy or an ablation never reads a text
again: ablations are sums over the few distinct values of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.text import BYTES, U, Rolling, Words, flat, mix, range_hashes, small_batches, spread, sum_by, texts_of

#: Words of the `insults` rule, in lower case.
INSULTS = ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_letters", "n_letter_words", "n_insults")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, an SQL condition on the measures, holds."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "stutter", "10 * n_stutter > 3 * n_words"),
    Rule(7, "capitals", "10 * n_upper > 3 * n_letters"),
    Rule(8, "few_letters", "10 * n_letter_words < 7 * n_words"),
    Rule(9, "insults", "n_insults >= 2 and 200 * n_insults >= n_words"),
)


def mask_of(*names: str) -> int:
    by_name = {r.name: r.bit for r in RULES}
    return sum(1 << by_name[n] for n in names)


#: Policy -> (version, mask). `base` is the part that every policy shares.
POLICIES = {
    "base": (1, mask_of("few_words", "repeated_words")),
    "prose": (1, mask_of("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "stutter", "capitals", "few_letters")),
    "strict": (1, (1 << len(RULES)) - 1),
}
_INSULT_HASHES = np.sort(Rolling(BYTES[np.frombuffer("".join(INSULTS).encode(), np.uint8)])(
    np.cumsum([0, *map(len, INSULTS[:-1])]), np.cumsum([*map(len, INSULTS)])))
_UPPER, _LETTER, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_SOLID = np.ones(256, bool)
_SOLID[128:192] = False  # continuation bytes of UTF-8
_LETTERISH = _LETTER.copy()
_LETTERISH[192:] = True


def _of_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different between documents."""
    return mix(h + (doc.astype(U) + U(1)) * U(0xA24BAED4963EE407))


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it equal to an earlier one; is it equal to any other one?"""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    later, any_other = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same
    same[:-1] |= same[1:]
    any_other[order] = same
    return later, any_other


def _measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, off)
    h, doc, n = w.hashes(), w.docs(), w.counts
    per_byte = lambda table: sum_by(table[data], off)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SOLID[data], out=solid[1:])
    chars = solid[w.end] - solid[w.start]
    letterish = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTERISH[data], out=letterish[1:])

    five = w.within(5)
    at = np.flatnonzero(five)
    twice = np.zeros(len(h), bool)
    twice[at] = _seen(_of_doc(Rolling(h).windows(5)[at], doc[at]))[1]
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    # Lines: between line feeds and the ends of the documents.
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, off]))
    end = cut[1:].copy()
    end[data[end - 1] == 10] -= 1  # the line feed is no part of its line
    start = cut[:-1]
    black = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[black], end[black]
    line_doc = np.searchsorted(off, start, "right") - 1
    again = _seen(_of_doc(range_hashes(BYTES[data], data, start, end), line_doc))[0]
    by_line = lambda v: np.bincount(line_doc, v, len(off) - 1).astype(np.int64)

    lower = w.hashes(lower=True)
    near = np.minimum(np.searchsorted(_INSULT_HASHES, lower), len(_INSULT_HASHES) - 1)
    return {
        "n_words": n, "word_chars": sum_by(chars, w.first), "n_symbols": per_byte(_SYMBOL), "n_lines": by_line(np.ones(len(start))),
        "n_dup_lines": by_line(again), "n_repeat_words": sum_by(spread(twice, 5), w.first), "n_stutter": sum_by(stutter, w.first),
        "n_upper": per_byte(_UPPER), "n_letters": per_byte(_LETTER), "n_letter_words": sum_by(letterish[w.end] > letterish[w.start], w.first),
        "n_insults": sum_by(_INSULT_HASHES[near] == lower, w.first),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: the id, the measures (long) and failed_bits (long).

    A null or blank text has no words and fails `few_words` alone; a null id
    stays null; repeated rows stay; `keep` keeps all columns of the input, of
    which those named like a measure give way to the measure. No shuffle.
    """
    small_batches(docs)
    taken = {*MEASURES, "failed_bits"}
    kept = [c for c in docs.columns if c not in taken] if keep else [id_col]
    source = docs.select(*kept, *([text_col] if text_col not in kept else []))
    source = source.withColumnRenamed(text_col, "text") if text_col != "text" else source
    names = [c if c != text_col else "text" for c in kept]
    out = T.StructType([source.schema[c] for c in names] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch):
                m = _measure(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(m[k].astype(np.int64)) for k in MEASURES], names=[*names, *MEASURES])

    measured = source.mapInArrow(run, out)
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0) for r in RULES), F.lit(0)).cast("long")
    measured = measured.withColumn("failed_bits", bits)
    return measured.withColumnRenamed("text", text_col) if text_col != "text" and "text" in names else measured


def passes(policy: str) -> Column:
    """Does a row of the ledger pass a policy?"""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy][1])) == 0


def passing(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with all their columns, whatever their names."""
    plain = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    text = plain.columns[docs.columns.index(text_col)]
    return ledger(plain, text_col=text, keep=True).where(passes(policy)).select(*plain.columns).toDF(*docs.columns)


def ablation(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: n_docs, n_rejected by the policy,
    n_failed by the rule, and n_only, those that the policy would keep without
    it. An empty ledger gives no rows. Reads bits only, which are combined
    before the shuffle: at most 2**rules sums leave a task."""
    masks = [(p, v, m, r.name, 1 << r.bit) for p, (v, m) in POLICIES.items() for r in RULES if m >> r.bit & 1]
    few = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(b).alias("bit")) for p, v, m, r, b in masks]))
    each = few.withColumn("x", table).select("n", "x.*", F.col("failed_bits").bitwiseAND(F.col("x.mask")).alias("bits"))
    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
