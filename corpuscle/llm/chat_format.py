"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
its reply alone is trainable. Turns after the last reply belong to no reply; a closing
example without a trainable part carries them, so that no turn is lost.

The template marks the turns of an example:

    system      ``<<SYS>>`` text ``<</SYS>>``
    user        ``<s>[INST]`` text ``[/INST]``
    assistant   ``<s>[OUT]`` text ``</s>``
    any other   ``<s>[ROLE]`` role ``[/ROLE]`` text ``</s>``

Within texts and roles ``%`` is written ``%25`` and the characters that open a mark
(``<`` and ``[``) are written ``%3C`` and ``%5B``; no control string can then stand in a
text, and unescaping is exact. Only built-in column functions are used.

Defined cases: a null text is empty and a null role the role ""; turns are ordered by
turn (nulls first), then role and text, so equal rows are both kept; a null conv_id is
a conversation of its own; an empty table gives an empty result. An example holds one
conversation up to a turn: the examples of one conversation grow with its square, as
the method has it, but no two conversations ever meet in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a turn of a role begins and ends with.
OPEN = {"system": "<<SYS>>", "user": "<s>[INST]", "assistant": "<s>[OUT]"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
#: A formatted turn: its mark, an escaped body without marks, its end.
TURN = r"(?s)(<<SYS>>[^<\[]*<</SYS>>|<s>\[INST\][^<\[]*\[/INST\]|<s>\[OUT\][^<\[]*</s>|<s>\[ROLE\][^<\[]*\[/ROLE\][^<\[]*</s>)"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("["), F.lit("%5B"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%5B"), F.lit("[")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def opening(role: Column) -> Column:
    out = F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))
    for name, mark in OPEN.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit("</s>")
    for name, mark in CLOSE.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example (from 0), last, n_turns, formatted, loss_start and loss_length.

    The loss mask is a range of ``formatted`` in code points, from 1; it is null in a
    closing example. ``last`` marks the example that holds the whole conversation.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv), said.alias("_t")).groupBy(conv).agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    pieces = F.transform("_t", lambda t: F.struct((t["role"] == "assistant").alias("reply"), opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), closing(t["role"]).alias("close")))
    chats = chats.select(conv, F.size("_t").alias("n"), pieces.alias("_p"))
    replies = F.filter(F.transform("_p", lambda p, i: F.when(p["reply"], i + 1)), lambda i: i.isNotNull())
    # The closing example ends with the last turn, if that is no reply.
    ends = F.when(F.element_at("_p", -1)["reply"], replies).otherwise(F.concat(replies, F.array("n")))
    examples = chats.select(conv, "n", "_p", F.posexplode(ends).alias("example", "end"))
    p = F.element_at(F.col("_p"), F.col("end"))
    context = F.array_join(F.transform(F.slice("_p", 1, F.col("end") - 1), lambda x: F.concat(x["open"], x["body"], x["close"])), "")
    parts = examples.select(conv, "example", "end", (F.col("end") == F.col("n")).alias("last"), F.concat(context, p["open"]).alias("_head"), p["body"].alias("_body"), p["close"].alias("_close"), p["reply"].alias("_reply"))
    return parts.select(
        conv, "example", "last", F.col("end").cast("long").alias("n_turns"), F.concat("_head", "_body", "_close").alias("formatted"),
        F.when(F.col("_reply"), F.length("_head") + 1).alias("loss_start"), F.when(F.col("_reply"), F.length("_body")).alias("loss_length"),
    )


def masked(examples: DataFrame) -> Column:
    """The trainable text of an example, unescaped; null if it has none."""
    return unescape(F.substring(F.col("formatted"), F.col("loss_start"), F.col("loss_length")))


def parse_turns(formatted: Column) -> Column:
    """Read an example back: an array of (role, text)."""
    def back(x: Column) -> Column:
        other = F.regexp_extract(x, r"(?s)^<s>\[ROLE\]([^<\[]*)\[/ROLE\]([^<\[]*)</s>$", 1)
        role = F.when(x.startswith("<<SYS>>"), "system").when(x.startswith("<s>[INST]"), "user").when(x.startswith("<s>[OUT]"), "assistant").otherwise(unescape(other))
        body = F.regexp_replace(x, r"^(?:<<SYS>>|<s>\[INST\]|<s>\[OUT\]|<s>\[ROLE\][^<\[]*\[/ROLE\])|(?:<</SYS>>|\[/INST\]|</s>)$", "")
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), 1), back)


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, what can be read back from its examples."""
    read = parse_turns(F.col("formatted"))
    told = F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select(
        conv, F.length("formatted").cast("long").alias("_chars"), F.when(F.col("last"), F.size(read)).alias("_n"), F.when(F.col("last"), F.sha2(told, 256)).alias("_turns"),
        F.when(F.col("loss_start").isNotNull(), F.struct(F.col("example").alias("i"), masked(examples).alias("x"))).alias("_loss"),
    )
    per = each.groupBy(conv).agg(F.max("_n").cast("long").alias("n_turns"), F.max("_turns").alias("turns_sha256"), F.sort_array(F.collect_list("_loss")).alias("_l"), F.sum("_chars").alias("formatted_chars"))
    per = per.withColumn("_x", F.array_join(F.transform("_l", lambda t: t["x"]), ""))
    return per.select(conv, "n_turns", "turns_sha256", F.length("_x").cast("long").alias("loss_chars"), F.sha2("_x", 256).alias("loss_sha256"), "formatted_chars")
