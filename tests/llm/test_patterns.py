"""Strings of the Thue-Morse pattern, which polynomial hashes modulo a power of
two confuse from 1,024 elements on: each operator against its plain version."""

import public_tokenizers
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tidegrid.llm import blocks, near, pieces, rules, suffixes, text, tokens, unigram

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def pattern(n, a="a", b="b"):
    x = [a]
    while len(x) < n:
        x += [b if c == a else a for c in x]
    return x


ONE, TWO = "".join(pattern(2048)), "".join(pattern(2048, "b", "a"))
FILL = " ".join(f"w{i}" for i in range(16))
DOCS = [f"{FILL} {ONE} {FILL.upper()}", f"{FILL} {TWO} {FILL.upper()}", f"{ONE} {TWO} " * 3, f"{ONE}\n{TWO}\nx y z w v u t s r q\n{ONE}", " ".join(pattern(2048, "ab", "cd")), " ".join(pattern(2048, "cd", "ab")), ONE, TWO]
ROWS = list(enumerate(DOCS))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_hashes():
    w = text.Words(*text.flat(pa.array([ONE, TWO, ONE, ONE[:64], TWO[:64]])))
    h = w.hashes()
    assert len(set(h.tolist())) == 4 and h[0] == h[2]


def test_operators(docs):
    got = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    for i, t in ROWS:
        assert {k: got[i][k] for k in brute.measures(t)} == brute.measures(t)
    same = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs).collect()}
    assert same == brute.near(ROWS)
    cut = {r["doc_id"]: r["n_removed"] for r in blocks.repeats(docs).collect()}
    assert cut == {i: sum(g) for (i, _), g in zip(ROWS, brute.repeated(ROWS, 35, brute.words))}
    cut = {r["doc_id"]: r["n_removed"] for r in suffixes.repeats(docs).collect()}
    assert cut == {i: sum(g) for (i, _), g in zip(ROWS, brute.repeated(ROWS, 200, lambda t: (t or "").encode()))}


def test_tokens(docs):
    tok = tokens.tokenizer(WORDS)
    ids, first = tokens.Encoder(WORDS)(pa.array(DOCS))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in DOCS]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["piece_ids_crc32"] for r in pieces.encode(docs, PIECES, p=0.0).collect()}
    assert got == {i: zlib.crc32(np.array(sp.encode(t), "<u4").tobytes()) for i, t in ROWS}


def test_scores_stand_alone(docs):
    """The score of a document doesn't depend on its neighbours."""
    together = {r["doc_id"]: r for r in unigram.token_counts(docs.coalesce(1), PIECES).collect()}
    alone = {r["doc_id"]: r for r in unigram.token_counts(docs.repartition(len(DOCS), "doc_id"), PIECES).collect()}
    assert together == alone and together[6]["n_tokens"] != 0
