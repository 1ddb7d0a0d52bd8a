"""Chat formatting: digests against a plain version, exact round trip, the plan."""

import hashlib
import itertools

from tidegrid.llm import chats

MARKS = [chats.OPEN, chats.SEP, chats.NEXT, chats.END]
ODD = ["", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|next|>", "<\\\\|end|> <\\/s>", "<<|end|>", "[[INST]", "a<", "|end|>", "<|end|", "line\n\nend\\", "é漢😀<|text|>", "<s><s>", "$1\\$2", " [INST][/INST] "]


def rows():
    r = [(1, i, ("user", "assistant", "assistant", "system", "")[i % 5], t) for i, t in enumerate(ODD)]
    r += [(2, 1, "assistant", "b"), (2, None, "user", None), (2, 0, None, "<|next|>"), (2, 1, "assistant", "b")]
    r += [(3, 0, "user", "hello"), (4, 0, "assi<|text|>stant", "x"), (4, 1, "user\n", "y"), (None, 0, "assistant", "no id"), (None, 1, "assistant", "again")]
    r += [(5, i, "assistant" if i % 3 else "user", f"turn {i} </s> " * 20) for i in range(700)]
    return r + [(6, 0, "user", "x" * 2_000_000 + "[INST]" * 1000)]


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn int, role string, text string")


def test_round_trip(spark):
    data = rows()
    got = chats.parse_chats(chats.format_chats(frame(spark, data).repartition(5))).collect()
    by = {}
    for c, k, role, text in data:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert {r["conv_id"] for r in got} == set(by) and len(got) == len(by)
    for r in got:
        want = [(role, text) for _, _, role, text in sorted(by[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == want, r["conv_id"]
        assert r["n_turns"] == len(want) and r["n_blocks"] == len([k for k, _ in itertools.groupby(want, lambda x: x[0])])
        seg = [tuple(s) for s in r["segments"]]
        assert sum(loss for _, loss in seg) == sum(role == "assistant" for role, _ in want)
        # A written text or role holds no control string; the marks are where they should be.
        marks = [t for t, loss in seg if t in MARKS or t.startswith(chats.OPEN)]
        assert len(marks) == r["n_blocks"] * 2 + r["n_turns"] - r["n_blocks"]
        whole = "".join(t for t, _ in seg)
        assert whole.count(chats.END) == whole.count(chats.OPEN) == whole.count(chats.SEP) == r["n_blocks"]
        assert whole.count(chats.NEXT) == r["n_turns"] - r["n_blocks"] and "[INST]" not in whole and "</s>" not in whole


def test_query_digests(spark, tmp_path):
    from tidegrid.llm.queries import QUERIES

    data = rows()
    frame(spark, data).write.parquet(f"{tmp_path}/conversations.parquet")
    data += [(-1, 0, "user", ODD[1]), (-1, 1, "assistant", ODD[1])]
    got = {r["conv_id"]: r for r in QUERIES["op11_chat_formatting"](spark, str(tmp_path)).collect()}
    by = {}
    for c, k, role, text in data:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    for c, turns in by.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got.pop(c)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not got


def test_native_empty_and_other_columns(spark):
    df = frame(spark, rows()[:9]).selectExpr("conv_id AS id", "turn AS t", "role AS who", "text AS segments", "1 AS conv", "2 AS n_turns")
    out = chats.format_chats(df, "id", "t", "who", "segments")
    assert out.columns == ["id", "n_turns", "n_blocks", "segments"] and out.count() == 1
    assert "Python" not in chats.parse_chats(out)._jdf.queryExecution().toString() and "Arrow" not in chats.parse_chats(out)._jdf.queryExecution().toString()
    assert chats.parse_chats(out.selectExpr("*", "1 AS turns", "2 AS __x")).first()["turns"][0]["role"] == "user"
    assert chats.parse_chats(chats.format_chats(frame(spark, []))).count() == 0
    none = chats.parse_chats(spark.sql("SELECT CAST(NULL AS array<struct<text:string,loss:boolean>>) AS segments")).first()
    assert none["turns"] == []
