"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import alignment, blocks, chats, langid, leaks, licenses, near, pieces, prefixes, rules, suffixes, tokens, unigram
from tidegrid.session import settle, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS five FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
twice AS (SELECT doc_id, five FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS p FROM g JOIN twice USING (doc_id, five)) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}\x{80}-\x{BF}]'))) AS n_letter_words,
    len(list_filter(w, lambda x: lower(x) IN (@INSULTS))) AS n_insults
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CAST(@BITS AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (failed_bits & @MASK) = 0 AS kept, failed_bits, n_lines, n_stutter, n_upper, n_letters, n_letter_words, n_insults FROM b""".replace(
    "@INSULTS", ", ".join(f"'{w}'" for w in rules.INSULTS)).replace(
    "@BITS", " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in rules.RULES))


def _rules(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    led = rules.ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed_bits").bitwiseAND(F.lit(rules.POLICIES["base"][1])) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.passes(policy).alias("kept"),
        "failed_bits", "n_lines", "n_stutter", "n_upper", "n_letters", "n_letter_words", "n_insults")


@query("op10_quality_rules", _RULES_SQL.replace("@MASK", str(rules.POLICIES["strict"][1])))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`kept` by the policy `strict`, which rejects toxic documents too."""
    return _rules(spark, sf_dir, "strict")


@query("op10_quality_rules_prose", _RULES_SQL.replace("@MASK", str(rules.POLICIES["prose"][1])))
def op10_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With `kept` by the policy `prose`, which leaves the rule on insults out."""
    return _rules(spark, sf_dir, "prose")


@query("op10_quality_rules_strict", _RULES_SQL.replace("@MASK", str(rules.POLICIES["strict"][1])))
def op10_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as op10_quality_rules; kept under its earlier name."""
    return _rules(spark, sf_dir, "strict")


_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
sets AS (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY 1),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM sets),
c AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n)
SELECT c.*, coalesce(class_id, c.doc_id) AS class_id, c.doc_id = component_id AS kept FROM c LEFT JOIN class USING (doc_id)"""


@query("op6_near_duplicates", _NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


_BLOCKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 34] AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
twice AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN twice USING (win)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)"""


@query("op5_substring_dedup", _BLOCKS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


@query("op2_piece_coding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    back = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, p=0.1, seed=1)
    lossless = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("piece_ids_crc32").alias("ids_crc32"), lossless.alias("lossless"))


@query("op9_token_output")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = os.path.join(shared_dir(spark), f"ids-{uuid.uuid4().hex}")
    tokens.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), out, end_id=2)
    return tokens.read_ids(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.train(docs.where(fold != 2), key=F.col("doc_id"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def _licenses_sql() -> str:
    rows, lengths = [], set()
    for k, v in licenses.TEMPLATES.items():
        n = len([w for w in re.split(licenses.GAP, v.lower()) if w])
        size = licenses.class_of(n)
        lengths.add(min(licenses.SHINGLE, n))
        rows.append(f"('{k}', '{v}', {size}, {licenses.stride(size)}, {min(licenses.SHINGLE, n)})")
    return r"""
WITH t AS (SELECT template, size, step, k, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM (VALUES @ROWS) AS v(template, text, size, step, k)),
ts AS (SELECT DISTINCT template, size, step, k, w[i:i + k - 1] AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
n AS (SELECT template, count(*) AS n FROM ts GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS i, w[i:i + k - 1] AS g FROM d, (SELECT unnest([@LENGTHS]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hit AS (SELECT doc_id, template, g, size, step, k, i FROM s JOIN ts USING (g)),
win AS (SELECT doc_id, template, j * step AS first, count(DISTINCT g) AS c FROM hit, LATERAL (SELECT unnest(range(greatest(0, ceil((i - (size - k)) / step))::BIGINT, (i // step) + 1)) AS j) GROUP BY ALL)
SELECT doc_id, template, max(c / n) AS containment, count(*) AS n_windows, min(first) AS first_word FROM win JOIN n USING (template) WHERE c / n >= 0.8 GROUP BY 1, 2""".replace(
        "@ROWS", ", ".join(rows)).replace("@LENGTHS", ", ".join(map(str, sorted(lengths))))


@query("op4_license_scan", _licenses_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_CHATS_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  regexp_replace(coalesce(role, ''), '@CONTROL', '\1\\\2\3', 'g') AS r, regexp_replace(coalesce(text, ''), '@CONTROL', '\1\\\2\3', 'g') AS x FROM t),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS fresh FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (fresh) AS n_blocks, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + CASE WHEN fresh THEN length(r) + @BLOCK ELSE @NEXT END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id""".replace("@CONTROL", chats.CONTROL).replace("@BLOCK", str(len(chats.OPEN + chats.SEP + chats.END))).replace("@NEXT", str(len(chats.NEXT)))


@query("op11_chat_formatting", _CHATS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted, written, and read back."""
    odd = "</s>[INST] ok [/INST]"
    told = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(told)
    read = chats.parse_chats(settle(chats.format_chats(turns), "chats"))
    turns_text, trained, whole = chats.turns_text(F.col("turns")), chats.trained(F.col("segments")), chats.formatted(F.col("segments"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_blocks", F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.length(whole).cast("long").alias("formatted_chars"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.link_stats(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns FROM t GROUP BY 1),
h AS (SELECT *, conv_id - conv_id % 100 AS base, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 6)::BIGINT AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
m AS (SELECT conv_id, d AS depth, turns[1:d] AS seq, len(turns) = d AS ends FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT seq[1:depth - 1] AS seq, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
c AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (seq, depth)),
s AS (SELECT seq[1:a] AS seq, a AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * CASE WHEN depth > 0 THEN length(seq[depth].text) ELSE 0 END)::BIGINT AS saved_tokens
  FROM c, LATERAL (SELECT unnest(range(0, depth + 1)) AS a) GROUP BY 1, 2)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM c JOIN s USING (seq, depth) LEFT JOIN n p ON p.seq = c.seq[1:c.depth - 1] AND p.depth = c.depth - 1"""


def _regrafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 100 in
    place of its own first h, h = crc32(c) % 6; and all conversations."""
    turns = settle(prefixes.numbered(turns), "turns")
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % 6
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = convs.select(c.alias("base"), F.col("n").alias("n_base"))
    # Turns that a conversation takes over: all of the base's, or h of them.
    convs = settle(convs.select("conv_id", (c - c % 100).alias("base"), h.alias("h")).join(base, "base", "left").select(
        "conv_id", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"), "h"), "convs")
    head = turns.where("pos < 5").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "taken"), "base").where("pos < taken")
    tail = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "taken", "h"), "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    cols = ["conv_id", "pos", "role", "text"]
    return head.select(*cols).unionAll(tail.select(*cols)), convs


@query("op13_prefix_trie", _TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(*_regrafted(table(spark, sf_dir, "conversations")))
