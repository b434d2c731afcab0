"""Chat formatting with Spark expressions only.

A conversation's turns are sorted, adjacent turns of one role share a block,
and the blocks are concatenated:

    system      [SYS]text[/SYS]
    user        [INST]text[/INST]
    assistant   <s>text</s>
    any other   [ROLE]role[AS]text[/ROLE]

Merged turns are parted by ``[SEP]``, so that nothing is lost. A control string
inside a text gets a backslash behind its first character, and one that already
has backslashes there gets one more; reading takes one away again.

NULL texts and roles count as empty; a NULL conversation id is one conversation
of its own; turns with equal numbers are ordered by role and text, NULL turn
numbers come first; repeated rows are turns of their own. Only the four named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by this template: the strings that structure a formatted conversation.
CONTROL = r"(<|\[)(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|AS\]|SEP\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|AS\]|SEP\])"
BLOCKS = r"(?=\[SYS\]|\[INST\]|<s>|\[ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _head(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[AS]"))
    return F.when(role == "system", "[SYS]").when(role == "user", "[INST]").when(role == "assistant", "<s>").otherwise(other)


def _tail(role: Column) -> Column:
    return F.when(role == "system", "[/SYS]").when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_mask``.

    ``loss_mask`` is an array of runs ``(chars, loss)`` in code points over the
    formatted string; only what assistants say is true.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("said"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    turns_of = F.col("turns")

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.try_element_at(turns_of, i)["role"] != t["role"])
        closes = (i == F.size(turns_of) - 1) | (F.try_element_at(turns_of, i + 2)["role"] != t["role"])
        # element_at counts from 1 and rejects 0, which only the first turn asks for
        opens = F.when(i == 0, F.lit(True)).otherwise(opens)
        return F.struct(
            F.when(opens, _head(t["role"])).otherwise("[SEP]").alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, _tail(t["role"])).otherwise("").alias("tail"),
            (t["role"] == "assistant").alias("loss"),
        )

    pieces = gathered.select("conv_id", F.transform("turns", piece).alias("pieces"))
    run = lambda part, loss: F.struct(F.char_length(part).alias("chars"), loss.alias("loss"))
    mask = F.flatten(
        F.transform(
            "pieces", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(p["tail"], F.lit(False)))
        )
    )
    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select("conv_id", joined.alias("formatted"), F.filter(mask, lambda r: r["chars"] > 0).alias("loss_mask"))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the true runs of a ``loss_mask``, cut out of the formatted string and unescaped."""
    kind = "struct<at:int,found:array<struct<at:int,chars:int>>>"
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,chars:int>>").alias("found")).cast(kind)

    def step(s: Column, r: Column) -> Column:
        own = F.array(F.struct(s["at"].alias("at"), r["chars"].alias("chars")))
        found = F.when(r["loss"], F.concat(s["found"], own)).otherwise(s["found"])
        return F.struct((s["at"] + r["chars"]).alias("at"), found.alias("found")).cast(kind)

    runs = F.aggregate(mask, none, step)["found"]
    return F.transform(runs, lambda r: unescape(F.substring(formatted, r["at"], r["chars"])))


def read_conversations(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """Adds ``turns``, an array of ``(role, text)``, read back from the formatted strings."""

    def body(block: Column, head: Column | int, tail: int) -> Column:
        return F.substring(block, F.lit(head) + 1, F.char_length(block) - head - tail)

    def opened(block: Column) -> Column:
        named = F.instr(block, "[AS]")
        pair = lambda r, b: F.struct(r.alias("role"), b.alias("body"))
        return (
            F.when(F.startswith(block, F.lit("<s>")), pair(F.lit("assistant"), body(block, 3, 4)))
            .when(F.startswith(block, F.lit("[INST]")), pair(F.lit("user"), body(block, 6, 7)))
            .when(F.startswith(block, F.lit("[SYS]")), pair(F.lit("system"), body(block, 5, 6)))
            .otherwise(pair(unescape(F.substring(block, F.lit(7), named - 7)), F.substring(block, named + 4, F.char_length(block) - named - 10)))
        )

    blocks = F.filter(F.split(F.col(text), BLOCKS, -1), lambda b: b != "")
    said = F.flatten(
        F.transform(
            F.transform(blocks, opened),
            lambda b: F.transform(F.split(b["body"], r"\[SEP\]", -1), lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))),
        )
    )
    return formatted.withColumn("turns", said)
