"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it.

A turn is written as a header line, its escaped text and an end mark. Escaping takes the control
strings out of texts and roles and can be undone, so an example reads back to exactly its turns.
Everything is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, COLON, END = "### ", ":\n", "</turn>\n"


def escape(c: Column) -> Column:
    """Text without "###", "</turn>" or a bare backslash; undone by ``unescape``."""
    for plain, written in (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in (("###", "\\h"), ("</turn>", "\\e"), ("\\", "\\b")):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def escape_role(c: Column) -> Column:
    """As ``escape``, and on one line, so that the header ends at the first ":" before a line feed."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars, last) from rows (conv_id, turn, role, text).

    One example per turn of ``target_role``: ``text`` is all turns before it and the reply itself, the
    reply at characters ``loss_start`` .. ``loss_start + loss_chars`` is the only trainable part. Turns
    after the last reply give one more example with nothing trainable (``loss_start`` null), so that a
    conversation is never cut short. ``last`` marks the example that holds the whole conversation.

    Null roles and texts count as empty, a null conv_id is a conversation of its own, a null turn
    comes first. Rows of equal turn are ordered by role, then text; repeated rows are repeated turns.
    An empty table gives no examples; other columns are not read. Output grows with the square of a
    conversation's turns, which is what prefix examples are; nothing grows across conversations.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(COLON))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == target_role).alias("targets"),
    )
    ends = F.when(F.element_at(F.concat(F.array(F.lit(0)), "targets"), -1) == F.size("parts"), F.col("targets"))
    exploded = written.select(
        "*", F.posexplode(F.coalesce(ends, F.concat("targets", F.array(F.size("parts"))))).alias("example", "upto")
    )
    text = F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "")
    trainable = F.array_contains("targets", F.col("upto"))
    reply = F.element_at("parts", F.col("upto"))
    inside = F.length(reply) - F.element_at("heads", F.col("upto")) - len(END)
    return exploded.select(
        "conv_id",
        "example",
        text.alias("text"),
        F.when(trainable, F.length(text) - len(END) - inside).alias("loss_start"),
        F.when(trainable, inside).alias("loss_chars"),
        (F.col("upto") == F.size("parts")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.slice(F.split(text, END), F.lit(1), F.size(F.split(text, END)) - 1)

    def one(part: Column) -> Column:
        at = F.instr(part, F.lit(COLON))
        return F.struct(
            unescape_role(F.substring(part, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(part, at + len(COLON), F.length(part))).alias("text"),
        )

    return F.transform(parts, one)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns, trainable text and sizes, all from ``text``."""
    turns = read_turns(F.col("text"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    narrow = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("piece"),
        F.when(F.col("last"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("last"), F.sha2(lines, 256)).alias("turns_sha256"),
        F.length("text").cast("long").alias("chars"),
    )
    pieces = F.transform(F.array_sort(F.collect_list("piece")), lambda p: F.coalesce(p["loss"], F.lit("")))
    return (
        narrow.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_join(pieces, "").alias("loss"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
