"""Token counts under a unigram model, by a forward pass over a trie.

A pre-token is a word with the space mark before it. The distinct pre-tokens of
a slice of documents form a trie; a node, that is a prefix, holds the best score
of any segmentation of it and that segmentation's number of tokens, worked out
once from its ancestors for all pre-tokens that share it. Terminal nodes give
the pre-tokens' counts, and a document's count is a sum over its words.

Scores are those of the model's pieces. A character that no piece spells costs
UNKNOWN below the lowest score and counts as its UTF-8 bytes. Of equally good
segmentations the one of fewest tokens counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.text import U, Rolling, Words, flat, mix, small_batches, sum_by, texts_of

MARK, UNKNOWN, LONG_WORD, SLICE = 0x2581, 10.0, 200, 1 << 21


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U) + U(1))


@dataclass
class Pieces:
    keys: np.ndarray  # sorted hashes
    score: np.ndarray
    maybe: np.ndarray  # is there a piece whose hash begins with these 20 bits?
    longest: int
    unknown: float
    by_text: dict[str, float]


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return table_of({sp.id_to_piece(i): float(sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


def table_of(scores: dict[str, float]) -> Pieces:
    """From a dictionary of piece and score; spaces are written U+2581."""
    text = "".join(scores)
    end = np.cumsum([len(p) for p in scores])
    start = end - [len(p) for p in scores]
    h = Rolling(_values(np.frombuffer(text.encode("utf-32-le"), np.uint32)))(start, end)
    order = np.argsort(h)
    maybe = np.zeros(1 << 20, bool)
    maybe[h >> U(44)] = True
    return Pieces(h[order], np.array(list(scores.values()))[order], maybe, max(map(len, scores)), min(scores.values()) - UNKNOWN, scores)


def _utf8(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def _scan(p: Pieces, word: str) -> tuple[float, int]:
    """The forward pass of one long pre-token."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - p.longest), end):
            s = p.by_text.get(word[start:end])
            if s is None and start == end - 1:
                got = best[start][0] + p.unknown, best[start][1] - len(word[start].encode())
            elif s is None:
                continue
            else:
                got = best[start][0] + s, best[start][1] - 1
            top = got if top is None or got > top else top
        best.append(top)
    return best[-1][0], -best[-1][1]


def trie_counts(p: Pieces, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and number of tokens of each pre-token, codes[first[i]:first[i + 1]]."""
    score, tokens = np.zeros(len(first) - 1), np.zeros(len(first) - 1, np.int64)
    size = np.diff(first)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        score[i], tokens[i] = _scan(p, codes[first[i] : first[i + 1]].tobytes().decode("utf-32-le"))
    short = np.flatnonzero(size <= LONG_WORD)
    roll = Rolling(_values(codes))
    n = size[short]
    depth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
    end = np.repeat(first[short], n) + depth
    # Nodes: distinct prefixes, numbered by depth; node 0 is the root.
    prefix = roll(end - depth, end)
    _, seen, node = np.unique(prefix, return_index=True, return_inverse=True)
    order = np.argsort(depth[seen], kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    node = number[node]
    at = seen[order]  # a place of each node, by number
    d, e = depth[at], end[at]
    parent = np.where(d > 1, node[at - 1], 0)
    levels = np.searchsorted(d, np.arange(1, int(d.max() if len(d) else 0) + 2))
    # Which last pieces does each node allow, and where do they begin?
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    above = np.arange(1, len(at) + 1)
    up = np.append(0, parent)
    single = np.zeros(len(at), bool)
    for length in range(1, p.longest + 1):
        above = up[above]
        some = np.flatnonzero(d >= length)
        if not len(some):
            break
        h = roll(e[some] - length, e[some])
        may = p.maybe[h >> U(44)]
        some, h = some[may], h[may]
        k = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
        ok = p.keys[k] == h
        some, k = some[ok], k[ok]
        if length == 1:
            single[some] = True
        steps.append((some, above[some], p.score[k]))
    best, count = np.full(len(at) + 1, -np.inf), np.zeros(len(at) + 1, np.int64)
    best[0] = 0
    cuts = [np.searchsorted(s[0], levels) for s in steps]
    lone = _utf8(codes[e - 1])
    for level, (a, b) in enumerate(zip(levels, levels[1:])):
        odd = a + np.flatnonzero(~single[a:b])
        best[odd + 1], count[odd + 1] = best[parent[odd]] + p.unknown, count[parent[odd]] + lone[odd]
        for (own, came, s), cut in zip(steps, cuts):
            x = slice(cut[level], cut[level + 1])
            i, value, tok = own[x] + 1, best[came[x]] + s[x], count[came[x]] + 1
            win = (value > best[i]) | ((value == best[i]) & (tok < count[i]))
            best[i[win]], count[i[win]] = value[win], tok[win]
    last = node[np.cumsum(n) - 1]
    score[short], tokens[short] = best[last], count[last]
    return score, tokens


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_words, n_tokens and score (the sum of the
    best scores of the words).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A null or blank text has
    none: zeros. A null id stays null; a repeated row is counted again. No
    shuffle: a slice's trie is bounded by the slice."""
    small_batches(docs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for batch in batches:
            for part in texts_of(batch, SLICE):
                data, off = flat(part.column("text"))
                w = Words(data, off)
                _, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                raw = data.tobytes()
                words = [chr(MARK) + raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
                codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
                score, tokens = trie_counts(p, codes, np.append(0, np.cumsum([len(x) for x in words])).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts), pa.array(sum_by(tokens[back], w.first)), pa.array(np.bincount(w.docs(), score[back], w.n_docs))], names=["doc_id", "n_words", "n_tokens", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, score double").withColumnRenamed("doc_id", id_col)
