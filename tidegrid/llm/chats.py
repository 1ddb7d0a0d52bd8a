"""Chat formatting with Spark expressions only.

A conversation is written as blocks, one per run of adjacent turns of the same
role. Four control strings mark it:

    OPEN role SEP text [NEXT text ...] END

NEXT stands between the texts that were merged, so the turns can be read back.
Inside roles and texts every control string, ours or another template's, gets a
backslash after its first character, and one that has backslashes there gets
one more: `</s>` is written `<\\/s>` and `<\\/s>` is written `<\\\\/s>`. That is
undone by taking one backslash away, and no written text holds a control string.

The output is a list of segments (text, loss). Their texts, joined, are the
formatted conversation; `loss` is true for the texts of the assistant alone, so
the mask needs no offsets, which would cost a pass over the text for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: All of them begin with < or [ and have neither further on, so that two
#: occurrences never overlap and none begins in a text and ends in a mark.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>)"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _with(value: Column, body) -> Column:
    """body(value), with value computed once though body may use it often."""
    return F.transform(F.array(value), body)[0]


def _blocks(turns: Column) -> Column:
    """Sorted (turn, role, text) structs -> (role, texts) of runs of one role."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def role(i: Column) -> Column:
        return F.get(turns, i - 1).getField("role")

    starts = F.filter(places, lambda i: (i == 1) | (role(i) != role(i - 1)))
    return _with(starts, lambda at: F.transform(at, lambda i, k: F.struct(
        role(i).alias("role"),
        F.transform(F.slice(turns, i, F.coalesce(F.get(at, k + 1), n + 1) - i), lambda x: x["text"]).alias("texts"),
    )))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(block: Column) -> Column:
    """Marks without loss and texts, in turn; END closes the block."""
    loss = block["role"] == TRAINED
    texts = F.transform(block["texts"], lambda t, k: F.array(
        _segment(F.when(k == 0, F.concat(F.lit(OPEN), block["role"], F.lit(SEP))).otherwise(F.lit(NEXT)), F.lit(False)),
        _segment(t, loss),
    ))
    return F.concat(F.flatten(texts), F.array(_segment(F.lit(END), F.lit(False))))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(<conv>, n_turns, n_blocks, segments array<struct<text, loss>>), one row
    per conversation; other columns are not read.

    Turns stand in the order of `turn`, null first; at ties by role, then text, as written;
    repeated rows are repeated turns. A null role or text is empty. Rows without
    an id make one conversation without an id. No rows give an empty table.
    Texts are escaped before the shuffle, row by row; the one shuffle brings
    each conversation into a row, which is the size that the output has anyway.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), *[escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in ((role, "role"), (text, "text"))]).alias("one"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    blocks = whole.select("conv", F.size("turns").cast("long").alias("n_turns"), _with(F.col("turns"), _blocks).alias("blocks"))
    return blocks.select(F.col("conv").alias(conv), "n_turns", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", _segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained(segments: Column) -> Column:
    """The original text under the loss mask, joined without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse_chats(chats: DataFrame, segments: str = "segments", out: str = "turns") -> DataFrame:
    """All columns, with the turns read back from the formatted text alone:
    array<struct<role, text>>, one per original row; a column of that name is
    replaced. A null or empty list has no turns."""
    literal = {m: m.replace("|", r"\|") for m in (NEXT, END)}

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), SEP, 1))
        body = F.substring(block, F.locate(SEP, block) + len(SEP), F.lit(1 << 30))
        return F.transform(F.split(body, literal[NEXT], -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    parts = F.split(formatted(F.coalesce(F.col(segments), F.array().cast("array<struct<text:string,loss:boolean>>"))), literal[END], -1)
    # What follows the last END is empty.
    return chats.withColumn(out, F.flatten(F.transform(_with(parts, lambda p: F.slice(p, 1, F.size(p) - 1)), turns_of)))


def turns_text(turns: Column) -> Column:
    """role, line feed, text, line feed of each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
