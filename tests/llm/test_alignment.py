"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tidegrid.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c", "a\n b\n\n c \t d", "x  y  z", "  a 　b", "漢字 かな 漢字", "é è 😀😀 naïve", "it's 12.5% don't ", "<|endoftext|> </s> <s>", "▁ literal", "a▁b c",
       "<0x41> <0x0A>", "one two three " * 400, "x" * 3000, "same words here", "same words here", "\x00 a\x01 b", "é ä", "한국어 문장 😀", "﻿bom a", "tab\tand\rcr \x0b\x0c v"]


def byte_of():
    """The byte of each letter of byte-level vocabularies, as the library pairs them."""
    out, left = {}, 0
    for b in range(256):
        c = chr(b)
        if not ("!" <= c <= "~" or "¡" <= c <= "¬" or "®" <= c <= "ÿ"):
            c, left = chr(256 + left), left + 1
        out[c] = b
    return out


def tokens_of(texts):
    a, b, letter = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        wa = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
        wb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not t or not b"".join(wa) == b"".join(wb) == (" " + t).encode():
            ia, ib, wa, wb = [], [], [], []
        yield ia, ib, np.cumsum([len(w) for w in wa]).tolist(), np.cumsum([len(w) for w in wb]).tolist()


def plain(rows):
    per, counts = [], Counter()
    for (i, _), (ia, ib, ea, eb) in zip(rows, tokens_of([t for _, t in rows])):
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links, first = [], 0
        for x in range(len(ia)):
            while eb[first] <= sa[x]:
                first += 1
            y = first
            while y < len(ib) and sb[y] < ea[x]:
                links.append((ia[x], ib[y]))
                y += 1
        groups, pa_, pb = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            qa, qb = ea.index(e, pa_) + 1, eb.index(e, pb) + 1
            groups.append((ia[pa_:qa], ib[pb:qb]))
            pa_, pb = qa, qb
        per.append((i, ia, ib, groups, links))
        counts.update(set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for i, ia, ib, groups, links in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(ia), len(ib), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return out, per


def test_against_plain_version(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(100_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (7, "an id twice")]
    monkeypatch.setattr(alignment, "PACK_BYTES", 1 << 16)
    monkeypatch.setattr(alignment, "SLICE", 1 << 14)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pack_id int, pair string").repartition(5)
    got = alignment.link_stats(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want, per = plain(rows)
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[1] > w[2] for w in want) > 5 and sum(w[1] < w[2] for w in want) > 5  # either side drives
    lists = {r["doc_id"]: r for r in alignment.align(df.withColumn("a_ids", df.pair), A, B).collect() if r["doc_id"] and r["doc_id"] > 7}
    for i, ia, ib, groups, _ in per:
        if i in lists:
            r = lists[i]
            cuts = list(zip([0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"]))
            assert [(r["a_ids"][a:b], r["b_ids"][c:d]) for a, b, c, d in cuts] == groups and (r["a_ids"], r["b_ids"]) == (ia, ib), i


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_stats(none, A, B).count() == alignment.align(none, A, B).count() == 0
    null = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.link_stats(null, A, B).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 2


def test_gallop_is_a_search():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (3000, 5), (700, 40_000), (5, 3000), (3000, 3000)):
        listed, wanted = np.unique(r.integers(0, 10 * m, m)), np.unique(r.integers(0, 10 * m, n))
        got = alignment.gallop(wanted, listed, np.zeros(1, np.int64), np.array([0, len(wanted)]))
        assert (got == np.searchsorted(listed, wanted)).all()


def test_chunks_equal_whole_texts():
    texts = [t for t in ODD if t]
    a, b = alignment.pair_of(A, B)(pa.array(texts))
    for k, (ia, ib, ea, _) in enumerate(tokens_of(texts)):
        assert a.ids[a.first[k] : a.first[k + 1]].tolist() == ia and b.ids[b.first[k] : b.first[k + 1]].tolist() == ib, texts[k]
