"""The operators on small tables, against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tidegrid.llm import blocks, graph, langid, leaks, licenses, near, pieces, queries, rules, suffixes, tokens, unigram

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  \n\t ", "one", "É ñ 日本語 😀", "a b c d", "word " * 400, "x" * 70_000, "▁ literal ▁▁ mark", "tab\tand\r\nlines\x0b\x0cend", "no-break space and 　 wide"]
PIECES, WORDS = queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("word_bpe_49k.json")


def frame(spark, texts, **more):
    """Documents with ids from 0, a column for each of `more`, and extra ones with names that clash."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("kept", "n_words", "ids", "key", "bucket", "pack_id", "tile", "score", "failed_bits", "class_id")})


@pytest.fixture(scope="module")
def texts(spark):
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(110).collect()]
    rng, out = random.Random(5), list(own)
    for t in own[:12]:
        w = t.split()
        for _ in range(3):  # near copies, of which some link only through others
            v = list(w)
            for k in rng.sample(range(len(v)), max(1, len(v) // 60)):
                v[k] = f"edit{rng.randrange(999)}"
            out.append(" ".join(v))
    passage = " ".join(own[20].split()[:45])
    out += [f"{a} {passage} {b}" for a, b in zip(own[30:36], own[40:46])] + [own[3], own[3]] + ODD + ODD[:4]
    return out


def pairs(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 2000 + k) for k in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert pairs(got, "id", "label") == {x: (y,) for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("shares", [1, 4, 64])
def test_components_of_hubs(spark, monkeypatch, shares):
    """Hubs whose id is the smallest, the largest and in between, joined by chains."""
    monkeypatch.setattr(graph, "SHARES", shares)
    edges = [(0, 100 + k) for k in range(300)] + [(9000, 1000 + k) for k in range(300)] + [(1150, 1500 + k) for k in range(300)] + [(399, 5000), (5000, 5001), (5001, 1299)]
    got = graph.components(spark.createDataFrame(edges + [(7001, 7000)], "a long, b long"))
    assert pairs(got, "id", "label") == {x: (0,) for e in edges for x in e} | {7000: (7000,), 7001: (7000,)}


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_links_of_a_tile(percent):
    """Sets over few values, so that many pairs lie on either side of the bound; two tiles, one of a single set."""
    rng = random.Random(percent)
    base = [{rng.randrange(300) for _ in range(rng.randrange(1, 60))} for _ in range(4)]
    sets = []
    for _ in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(8)):
            s.add(rng.randrange(400))
            s.discard(rng.choice(sorted(s)) if len(s) > 1 and rng.random() < 0.5 else None)
        sets.append(np.array(sorted(s), np.uint64))
    rows = pa.RecordBatch.from_arrays([pa.array(range(121)), pa.array([s.tobytes() for s in [*sets, sets[0]]], pa.binary())], names=["class_id", "shingles"])
    label = list(range(121))
    for a, b in near._linked_sets(percent)(np.array([0, 120, 121]), rows):
        for x, y in zip(a.tolist(), b.tolist()):
            label[y] = x
    want = list(range(121))
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    assert label == want and 1 < len(set(want)) < 121


def test_rules(spark, texts):
    got = rules.ledger(frame(spark, texts), keep=True)
    by_id = {r["doc_id"]: r for r in got.collect()}
    want = {i: brute.measures(t) for i, t in enumerate(texts)}
    bits = {i: sum(1 << k for k, bad in enumerate(brute.fails(m)) if bad) for i, m in want.items()}
    for i, m in want.items():
        assert {k: by_id[i][k] for k in rules.MEASURES} == m, texts[i]
        assert by_id[i]["failed_bits"] == bits[i]
    passed = rules.passing(frame(spark, texts), "prose")
    assert passed.columns == frame(spark, texts).columns
    assert {r["doc_id"] for r in passed.collect()} == {i for i, b in bits.items() if not b & rules.POLICIES["prose"][1]}
    for r in rules.ablation(got).collect():
        mask, bit = rules.POLICIES[r["policy"]][1], rules.mask_of(r["rule"])
        n = Counter("rejected" for b in bits.values() if b & mask) + Counter("failed" for b in bits.values() if b & bit) + Counter("only" for b in bits.values() if b & mask == bit)
        assert (r["n_docs"], r["n_rejected"], r["n_failed"], r["n_only"]) == (len(texts), n["rejected"], n["failed"], n["only"])


def test_toxic_documents_go(spark):
    """Of the pipeline's quality stage and the query by its policy, nothing that fails `insults` is kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fails = {r["doc_id"]: brute.fails(brute.measures(r["text"])) for r in docs.collect()}
    want = {i for i, f in fails.items() if not any(f)}
    assert want < {i for i, f in fails.items() if not any(f[:9])}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} == want
    assert {r["doc_id"] for r in queries.QUERIES["op10_quality_rules_strict"](spark, SF).where("kept").collect()} == want


@pytest.mark.parametrize("block", [4096, 3])
def test_near(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near, "BUCKET_BLOCK", block)  # hot buckets and clusters go to pairs of blocks
    monkeypatch.setattr(near, "CLUSTER_DOCS", block)
    want = brute.near(list(enumerate(texts)))
    got = pairs(near.near_duplicates(frame(spark, texts)), "doc_id", "component_id", "kept", "n_shingles")
    assert {i: c for i, (c, _, _) in got.items()} == want
    assert all(k == (i == c) for i, (c, k, _) in got.items())
    assert all(n == len(brute.shingles(brute.words((texts[i] or "").translate(brute.LOW)))) for i, (_, _, n) in got.items())


def test_near_all_linked_and_none(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def edited(n):
        return " ".join(f"e{rng.randrange(10**6)}" if k in at else x for at in [set(rng.sample(range(400), n))] for k, x in enumerate(base))

    texts = [edited(9) for _ in range(60)] + [" ".join(base)] + [edited(16) for _ in range(40)]
    got = pairs(near.near_duplicates(frame(spark, texts)), "doc_id", "component_id")
    assert {i: c for i, (c,) in got.items()} == brute.near(list(enumerate(texts)))


def test_near_at_80(spark):
    """The pipeline's stage takes pairs between 0.80 and 0.85, and none below."""
    assert all(near.layout(p).missed(p) < 1e-6 for p in range(80, 101)) and near.layout(85).symbols == 65
    rng, texts = random.Random(12), []
    for n in (8, 9, 12):  # words changed of 400, each in five shingles: similarities of about 0.82, 0.80 and 0.74
        for _ in range(8):
            base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
            at = set(range(20, 20 + 30 * n, 30))
            texts += [" ".join(base), " ".join(f"e{rng.randrange(10**6)}" if k in at else x for k, x in enumerate(base))]
    want, strict = brute.near(list(enumerate(texts)), 80), brute.near(list(enumerate(texts)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), SF).select("doc_id").collect()}
    assert kept == {i for i, c in want.items() if i == c} and len(kept) < sum(i == c for i, c in strict.items()) and len(kept) > len(texts) // 2


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (2, "a b c d e f g h"), (3, None)]
    got = [tuple(r) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "component_id", "kept").collect()]
    assert Counter(got) == Counter([(None, None, None, True)] * 2 + [(4, 4, 4, True)] * 2 + [(2, 2, 2, True), (3, 3, 3, True)])


@pytest.mark.parametrize("length", [5, 35])
def test_blocks(spark, texts, length):
    rows = list(enumerate(texts))
    gone = brute.repeated(rows, length, brute.words)
    got = pairs(blocks.repeats(frame(spark, texts), length, pack_bytes=20_000), "doc_id", "n_words", "n_removed", "kept_sha256", "spans")
    for (i, t), g in zip(rows, gone):
        w = brute.words(t)
        n, removed, sha, spans = got[i]
        assert (n, removed, sha) == (len(w), sum(g), brute.sha(" ".join(x for x, y in zip(w, g) if not y).encode()))
        assert [k for s in spans for k in range(s.start, s.end)] == [k for k, y in enumerate(g) if y]
    cut = blocks.repeats(frame(spark, texts), length, cut=True, pack_bytes=20_000)
    assert cut.columns == frame(spark, texts).columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: brute.cut_words(t, g) for (i, t), g in zip(rows, gone)}


@pytest.mark.parametrize("first,hot,length", [(False, 500, 30), (True, 500, 30), (False, 0, 90), (True, 1, 90)])
def test_suffixes(spark, texts, first, hot, length):
    rows = list(enumerate([*texts[60:140], "ab" * 300, "a" * 900, *texts[-16:-8], *texts[-5:]]))
    rows = [(i, (t or "")[:3000] if t is not None else None) for i, t in rows]
    gone = brute.repeated(rows, length, lambda t: (t or "").encode(), first)
    df = frame(spark, [t for _, t in rows]).coalesce(1)
    got = pairs(suffixes.repeats(df, length, first, with_kept=True, pack_bytes=9_000, hot_packs=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    for (i, t), g in zip(rows, gone):
        kept = bytes(x for x, y in zip((t or "").encode(), g) if not y)
        n_spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        assert got[i] == (len(g), sum(g), n_spans, brute.sha(kept), kept), i


def test_longest_factors():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(380)
    lpf, lnf = suffixes.factors(text, starts, starts, 20)
    common = lambda a, b: next((k for k in range(20) if text[a + k] != text[b + k]), 20)
    for i in starts:
        for got, others in ((lpf[i], range(i)), (lnf[i], range(i + 1, 380))):
            want = max((common(i, j) for j in others), default=0)
            assert got == want or want < 8 and got <= want


def test_leaks(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = " ".join(texts[0].split()[:150])
    items = items[:12] + [(90, long), (91, None), (92, ""), (93, "Two words"), (93, "Two words"), (94, items[0][1])]
    rng = random.Random(4)
    w = [x for _, t in items[:12] for x in t.split()]
    docs = texts[:60] + [f"{texts[9]} {t} {texts[10]}" for _, t in items[:6]] + [f"{t[: len(t) // 2]} {texts[11]}" for _, t in items[:6]]
    docs += [" ".join(rng.sample(w, len(w))), "Intro $$$ " + items[3][1].replace(" ", "*** ") + " end", "two words", *ODD]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = leaks.leaks(frame(spark, docs), table)
    want = brute.leaks(list(enumerate(docs)), list({(i, t) for i, t in items if t}))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 9
    clean = leaks.without_leaks(frame(spark, docs), table)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_pieces(spark, texts):
    import sentencepiece

    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.model(PIECES)
    base = pairs(pieces.encode(frame(spark, texts), PIECES, p=0), "doc_id", "piece_ids", "piece_ids_crc32")
    for i, t in enumerate(texts):
        if "▁" not in (t or ""):
            assert base[i][0] == lib.encode(t or ""), t
        assert base[i][1] == zlib.crc32(np.array(base[i][0], "<u4").tobytes())
    varied = pieces.encode(frame(spark, texts), PIECES, p=0.3, seed=9)
    again = pairs(pieces.encode(frame(spark, texts).repartition(3), PIECES, p=0.3, seed=9), "doc_id", "piece_ids")
    got = pairs(pieces.decode(varied, PIECES), "doc_id", "decoded", "piece_ids")
    assert all(d == (texts[i] or "") for i, (d, _) in got.items())
    assert {i: x for i, (_, x) in got.items()} == {i: x for i, (x,) in again.items()}
    assert pairs(pieces.encode(frame(spark, texts), PIECES, p=0.3, seed=10), "doc_id", "piece_ids") != again
    assert sum(len(x) for _, x in got.values()) > sum(len(x) for x, _ in base.values())
    # Equal words of one text get several segmentations.
    ids, _ = pieces._encode(m, pieces._Dropout(0.5), 1, np.frombuffer(b"segmentation " * 50, np.uint8), np.array([0, 650]))
    assert len({tuple(lib.id_to_piece(i) for i in x) for x in np.split(ids, np.flatnonzero([lib.id_to_piece(int(i)).startswith("▁") for i in ids]))}) > 2


def test_pieces_there_and_back_in_one_pass(spark, texts):
    """The stage and the query have one Python node, so one worker a task with the model in it; rows are those of the two passes."""
    docs = frame(spark, texts).withColumns({"lang": F.lit("x"), "source": F.lit("y"), "decoded": F.lit("old")})
    both = pieces.encode_and_decode(docs, PIECES, p=0.3, seed=9)
    apart = pieces.decode(pieces.encode(docs, PIECES, p=0.3, seed=9), PIECES)
    assert both.columns == apart.columns and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    with pytest.raises(ValueError):
        pieces.encode_and_decode(docs, PIECES, out_col="text")
    for df in (corpus_pipeline.piece_coding(spark, docs, SF), queries.QUERIES["op2_piece_coding"](spark, SF)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_each_occurrence_is_segmented_by_itself(spark):
    """Not one of a few draws, nor the same in every copy of a text; and as if each chunk had an agenda of its own."""
    rows = [(i, "segmentation of words") for i in range(300)] + [(7, "segmentation of words")]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, p=0.3).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(tuple(r["piece_ids"]))
    assert len(set().union(*by.values())) > 20 and all(len(x) == 1 for x in by.values())
    m, drop = pieces.model(PIECES), pieces._Dropout(0.2)
    chunks = [[m.char_id[ord(c)] for c in x] for x in ("▁segmentation", "▁of", "▁" + "the" * 40, "▁")] * 50
    sym, first = np.concatenate(chunks), np.append(0, np.cumsum([len(x) for x in chunks]))
    key = np.random.default_rng(3).integers(0, 1 << 63, 200).astype(np.uint64)
    ids, at, which = pieces._varied(m, drop, sym, first, np.arange(4), np.arange(200) % 4, key)
    assert [ids[at[w] : at[w + 1]].tolist() for w in which] == [pieces._one_by_one(m, drop, np.array(c), int(k)).tolist() for c, k in zip(chunks, key)]
    assert (which < 4).any() and (which >= 4).any()


def test_agendas_agree():
    """All chunks at once, and each on its own heap."""
    m, rng = pieces.model(PIECES), random.Random(8)
    chunks = ["▁" + "".join(rng.choice("theaniorsg") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    sym = np.array([m.char_id[ord(c)] for x in chunks for c in x])
    first, key = np.append(0, np.cumsum([len(x) for x in chunks])), np.arange(200, dtype=np.uint64)
    for p in (0.0, 0.2, 0.9, 1.0):
        drop = pieces._Dropout(p)
        got, at = pieces._agendas(m, drop, sym, first, key)
        for c in range(200):
            assert got[at[c] : at[c + 1]].tolist() == pieces._one_by_one(m, drop, sym[first[c] : first[c + 1]], c).tolist()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == docs.count() and {r.doc_id for r in held} == {r.doc_id for r in got if r.held_out}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs)
    odd = langid.predict(frame(spark, [*ODD, "123 456 !!"]), model)
    got = pairs(odd, "doc_id", "lang_pred", "score")
    assert {i for i, (x, _) in got.items() if x == "und"} == {0, 1, 2, len(ODD)} and got[0][1] == 0
    assert langid.train(docs.where("lang is null")) is None
    assert pairs(langid.predict(frame(spark, ["a text"]), None), "doc_id", "lang_pred", "rejected") == {0: ("und", True)}


def test_unigram(spark, texts):
    p = unigram.pieces_of(PIECES)

    def best(word):
        now = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            c = [(now[s][0] + p.by_text[word[s:e]], now[s][1] - 1) for s in range(max(0, e - 16), e) if word[s:e] in p.by_text]
            if word[e - 1] not in p.by_text:
                c.append((now[e - 1][0] + p.unknown, now[e - 1][1] - len(word[e - 1].encode())))
            now.append(max(c))
        return now[-1]

    some = [*texts[:25], *ODD]
    got = pairs(unigram.token_counts(frame(spark, some), PIECES), "doc_id", "n_words", "n_tokens", "score")
    for i, t in enumerate(some):
        w = [best("▁" + x) for x in brute.words(t)]
        assert got[i] == (len(w), -sum(n for _, n in w), sum(s for s, _ in w)), t
    small = unigram.table_of({"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -3.0, "ba": -1.5})
    codes = np.frombuffer("▁aba".encode("utf-32-le"), np.uint32)
    assert [x.tolist() for x in unigram.trie_counts(small, codes, np.array([0, 4]))] == [[-4.5], [2]]


def test_code_lengths():
    rng = random.Random(6)
    for n in (1, 2, 3, 60):
        counts = {i: int(2 ** rng.uniform(0, 24)) for i in range(n)}
        for limit in (6, 16):
            got = tokens.code_lengths(counts, limit)
            assert max(got.values()) <= limit and sum(2.0**-x for x in got.values()) <= 1
    # Against plain Huffman where the limit doesn't bind, and all lengths where it does.
    counts = dict(enumerate([1, 1, 2, 3, 5, 8, 13]))
    assert sum(counts[i] * x for i, x in tokens.code_lengths(counts).items()) == 78
    cost = lambda ls: sum(c * x for c, x in zip([1, 1, 2, 3, 5], ls))
    best = min(cost(ls) for ls in np.ndindex(4, 4, 4, 4, 4) if min(ls) > 0 and sum(2.0**-x for x in ls) <= 1)
    assert cost([tokens.code_lengths(dict(enumerate([1, 1, 2, 3, 5])), 3)[i] for i in range(5)]) == best
    assert tokens.code_lengths({}) == {}


def test_token_files(spark, texts, tmp_path):
    out = str(tmp_path / "ids")
    rows = frame(spark, texts).unionAll(frame(spark, texts).where("doc_id = 3")).repartition(3)
    tokens.write_ids(rows, WORDS, out)
    got = tokens.read_ids(spark, out).collect()
    tok, start = tokens.tokenizer(WORDS), 0
    by = {}
    for i, t in sorted([*enumerate(texts), (3, texts[3])], key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        by.setdefault(i, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, *x[:3]) for i, v in by.items() for x in v)
    assert all(r["ids"] == by[r["doc_id"]][0][3] for r in got)


def test_encoder_cuts_only_where_the_tokenizer_does():
    enc, tok = tokens.Encoder(WORDS), tokens.tokenizer(WORDS)
    odd = ["It's DON'T we'LL 'tis", "ÀÉ,x É. ,a .. (Foo) \"Bar\" a-b x.y", "ß× ÷é é İ ΑΣ ΑΣ.", "<|endoftext|>x a<|startoftext|>", "3rd 12.5% a1b", "x y ... --- !?", "Ã À́"]
    ids, first = enc(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_licenses(spark):
    long = licenses.TEMPLATES["Apache-2.0-header"]
    docs = [f"{'filler words here ' * n} {long} {'and more of it ' * n}" for n in (0, 3, 40)] + [long.replace("law", "statute"), long.lower().replace(" ", "\n"), " ".join(long.split()[:12])]
    docs += ["ALL  rights, reserved", "all right reserved", "all rights " * 20, "word " * 9 + "all rights\nreserved all rights reserved"]
    docs += ["x " * 500 + t for t in licenses.TEMPLATES.values()] + ["Released under the MIT", *ODD]
    got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan(frame(spark, docs)).collect()}

    def norm(t):
        return [w for w in "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in (t or "").lower()).split()]

    want = {}
    for i, t in enumerate(docs):
        for name, text in licenses.TEMPLATES.items():
            n = min(5, len(norm(text)))
            sh = [tuple(norm(t)[k : k + n]) for k in range(len(norm(t)) - n + 1)]
            s, size = brute.shingles(norm(text)), licenses.class_of(len(norm(text)))
            share = max((len(s & set(sh[k : k + size - n + 1])) / len(s) for k in range(0, len(sh), licenses.stride(size))), default=0)
            if share >= 0.8:
                want[i, name] = share
    assert got == want and len(want) > 12
    assert "Python" not in licenses.scan(frame(spark, docs))._jdf.queryExecution().toString()


def test_empty_tables(spark, tmp_path):
    none = frame(spark, ["x"]).where("doc_id < 0")
    bench = spark.createDataFrame([(1, "some item text of a few words")], "item_id int, text string")
    results = [rules.ledger(none), near.near_duplicates(none), blocks.repeats(none), blocks.repeats(none, cut=True), suffixes.repeats(none), leaks.leaks(none, bench), leaks.without_leaks(none, bench),
               pieces.decode(pieces.encode(none, PIECES), PIECES), unigram.token_counts(none, PIECES), licenses.scan(none), langid.predict(none, langid.train(none))]
    assert [r.count() for r in results] == [0] * len(results)
    assert leaks.leaks(frame(spark, ["some text"]), bench.where("false")).count() == 0
    tokens.write_ids(none, WORDS, str(tmp_path / "e"))
    assert tokens.read_ids(spark, str(tmp_path / "e")).count() == 0


def test_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "the same long text of some words, again and again"), (1, "the same long text of some words, again and again")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "long text of some words, again and again")], "item_id int, text string")
    for r in (rules.ledger(df), near.near_duplicates(df), blocks.repeats(df, 5), suffixes.repeats(df, 20), leaks.leaks(df, bench), pieces.encode(df, PIECES), unigram.token_counts(df, PIECES)):
        assert {x["doc_id"] for x in r.collect()} == {None, 1}
    tokens.write_ids(df, WORDS, str(tmp_path / "n"))
    assert [tuple(r)[:2] for r in tokens.read_ids(spark, str(tmp_path / "n")).orderBy("start").select("doc_id", "start").collect()][0] == (None, 0)


def test_pipeline(spark):
    """All stages against the plain versions, one after the other."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if not any(brute.fails(brute.measures(t)))]
    label = brute.near(docs, percent=80)
    docs = [(i, t) for i, t in docs if label[i] == i]
    docs = [(i, brute.cut_words(t, g)) for (i, t), g in zip(docs, brute.repeated(docs, 35, brute.words))]
    docs = [(i, t) for i, t in docs if brute.words(t)]
    bad = {d for d, _ in brute.leaks(docs, items)}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(got, PIECES).collect()} == {i: t for i, t in docs if i not in bad}
    assert got.where("not lossless").count() == 0


def test_stages_take_odd_rows(spark, texts):
    rows = frame(spark, texts).unionAll(frame(spark, texts).limit(40)).unionAll(frame(spark, texts).limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert out.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
        if name == "near_dedup":
            assert out.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
