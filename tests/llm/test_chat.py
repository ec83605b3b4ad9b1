"""Operator 13 against a plain Python formatter and exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorframe.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|/role|>", "<|/turn|>", "<|image|>", "<|audio|>", "<|document|>"]
ROWS = "conv_id long, turn long, role string, text string, formatted string, n int"
PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def brute(rows):
    """conv_id -> digests by plain Python; the length of the output aside."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for *_, role, t in own if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for *_, role, t in own)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r[:4], "x", 1) for r in rows], ROWS)
    out = chat.chats(chat.text_parts(df))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == brute(rows)
    return {r.conv_id: r for r in out.collect()}


def test_odd_conversations(spark):
    hostile = "".join(CONTROLS) + "<\\s> <\\\\/s> [\\INST] \\ <[ <</s>> [[INST]] <|image|"
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", hostile), (1, 2, "assistant", hostile + hostile), (1, 3, "tool", "<|/turn|>\n"),
            (1, 4, "assistant", ""), (2, 0, "assistant", None), (2, 0, "assistant", None), (2, 0, "user", " x "), (None, None, None, None),
            (None, 2, "user", "nobody's"), (3, 0, "a<|/role|>\nb", "odd role"), (4, 0, "assistant", "Ünïcode 東京 \U0001f600 " * 20_000),
            (5, 0, "user", "[INST] nested [/INST]"), (5, 1, "assistant", "<<SYS>>first<</SYS>>"), (5, 2, "", "no role"), (5, 3, "assistant", "\\")]
    out = check(spark, rows)
    # whatever the texts say, the marks in the output are those of the template
    assert out[1].formatted.count("</s>") == 2 and out[1].formatted.count("[INST]") == 1 and out[1].formatted.count("<<SYS>>") == 1
    assert out[5].formatted.count("</s>") == 2
    assert [(s.turn, s.start) for s in out[1].loss_mask] == [(3, 1), (5, 1)]


def test_empty(spark):
    assert chat.digests(chat.chats(chat.text_parts(spark.createDataFrame([], ROWS)))).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CONTROLS + ["\\", "<", "[", "a", "\n", "|", "s>", "INST]", "/s>", " "]), max_size=12).map("".join), min_size=20, max_size=20))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROLS)
        if not any(c[1:] in r.t for c in CONTROLS):
            assert r.e == r.t


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <|image|> "), part("image", ref="s3://a", w=57, h=28), part("text", ""), part("audio", ref="b", s=1.5), None]),
            (1, 1, "assistant", [part("text", "a"), part("text", "b"), part("video", ref="c"), part("document", ref="d", p=3)]),
            (1, 2, "user", None), (1, 3, "user", [])]
    out = chat.chats(spark.createDataFrame(rows, PARTS)).first()
    assert out.formatted == ("[INST] see <\\|image|> <|image|><|audio|> [/INST]ab<|document|><|document|></s>[INST]  [/INST][INST]  [/INST]")
    assert [tuple(a) for a in out.attachments] == [(1, "image", "s3://a", 3), (1, "audio", "b", 38), (2, "document", "c", 0), (2, "document", "d", 3072)]
    assert out.expanded_tokens == 3 + 38 + 3072
    df = spark.createDataFrame([(out.formatted,)], "formatted string")
    bodies = df.select(F.transform(chat.turns_of(F.col("formatted")), lambda t: chat.parts_of(t["body"])).alias("p")).first().p
    assert [[tuple(x) for x in b] for b in bodies] == [
        [("text", "see <|image|> "), ("image", ""), ("audio", "")], [("text", "ab"), ("document", ""), ("document", "")], [], []]


@pytest.mark.parametrize("n", [3000])
def test_long_conversation(spark, n):
    check(spark, [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(n)])


def test_plan_is_native(spark):
    from factorframe.llm import queries

    plan = queries.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    assert plan.count("Exchange hashpartitioning") == 1
