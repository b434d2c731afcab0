"""Formatting and reading back, against the turns themselves and against SQL."""

import random

from compare import database, difference

from defectlab.llm import chat
from defectlab.llm.queries import INJECTION, QUERIES, SQL


def both(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}


def test_injection(spark):
    got = both(spark, [(-7, 0, "user", INJECTION), (-7, 1, "assistant", INJECTION)])[-7]
    assert [tuple(t) for t in got["turns"]] == [("user", INJECTION), ("assistant", INJECTION)]
    assert got["formatted"].count("</s>") == 1 and got["formatted"].count("[/INST]") == 1


def test_round_trip_of_odd_turns(spark):
    draw = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SEP]", "[AS]", "[ROLE]", "[/ROLE]", "[SYS]", "<", "[", "\\", "\\\\", "<\\s>", "[\\\\SEP]", "a", "\n", "é🙂", ""]
    roles = ["user", "assistant", "system", "tool", "[AS]", "", None]
    rows, want = [], {}
    for conv in range(150):
        for turn in range(draw.randrange(1, 9)):
            text = draw.choice([None, "".join(draw.choices(parts, k=draw.randrange(8)))])
            rows.append((conv, turn, draw.choice(roles), text))
            want.setdefault(conv, []).append((rows[-1][2] or "", text or ""))
    draw.shuffle(rows)
    found = both(spark, rows)
    assert {c: [tuple(t) for t in r["turns"]] for c, r in found.items()} == want
    for conv, r in found.items():
        loss, at = "", 0
        for run in r["loss_mask"]:
            loss += r["formatted"][at : at + run["chars"]] if run["loss"] else ""
            at += run["chars"]
        assert at == len(r["formatted"])
        escaped = [t for role, t in want[conv] if role == "assistant"]
        assert len(loss) >= len("".join(escaped))


def test_merges_neighbours(spark):
    got = both(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "")])[1]
    assert got["formatted"] == "[INST]a[SEP]b[/INST]<s>c</s>[INST][/INST]"


def test_ties_and_nulls(spark):
    found = both(spark, [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "system", "first")])
    assert [tuple(t) for t in found[None]["turns"]] == [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, turns int")
    assert chat.format_conversations(empty).collect() == []


def test_same_as_sql(spark, small):
    assert difference(QUERIES["op5_chat_format"](spark, small), database(small), SQL["op5_chat_format"]) is None


def test_query_reads_the_loss_mask(spark, small, monkeypatch):
    """A wrong mask shows in the query's loss columns."""
    right = {r["conv_id"]: r for r in QUERIES["op5_chat_format"](spark, small).collect()}
    real = chat.format_conversations
    monkeypatch.setattr(chat, "format_conversations", lambda turns: real(turns).selectExpr("conv_id", "formatted", "transform(loss_mask, r -> struct(r.chars AS chars, false AS loss)) AS loss_mask"))
    wrong = {r["conv_id"]: r for r in QUERIES["op5_chat_format"](spark, small).collect()}
    assert right[-7]["loss_chars"] == len(INJECTION)
    assert {r["loss_chars"] for r in wrong.values()} == {0}
    assert all(wrong[c]["turns_sha256"] == r["turns_sha256"] for c, r in right.items())
