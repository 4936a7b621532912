"""Chat formatting with prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of a turn, and control strings of common templates, which no formatted text or role contains.
OPEN, HEAD, END = "<|turn:", "|>\n", "<|end|>\n"
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    """text with a backslash after the first character of each control string, and each of its own backslashes doubled; null: empty."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    """What `escaped` made text of: of two backslashes one stays, and one that stands alone goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _head(role: Column) -> Column:
    """The mark that opens a turn. In a role every | is parted from what follows, as a last < is, so that none can end its own mark."""
    return F.concat(F.lit(OPEN), F.regexp_replace(F.replace(escaped(role), F.lit("|"), F.lit("|\\")), r"<\z", r"<\\"), F.lit(HEAD))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, is_whole, text, loss_start, loss_stop): an example for each assistant turn of conversations (conv_id,
    turn, role, text).

    text is every turn up to and with that one, formatted, n_turns their number; example numbers them from 1 within a conversation. Only
    the reply's text is trainable: code points loss_start (from 0) to loss_stop (not included) of text. If turns follow the last
    assistant turn, or there is none, one more example without a target (null places) holds the whole conversation, so that the output
    loses nothing. is_whole: whether text is all of its conversation, as that of the last example is.

    A turn is `<|turn:ROLE|>`, a line feed, its text, `<|end|>` and a line feed. Control strings in texts and roles (`<|`, `<s>`, `</s>`,
    `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`) are broken by a backslash, which `unescaped` takes out again.

    Turns are ordered by turn number (null first), equal ones by role, then text; repeated rows are turns of their own. A null role
    is an empty one, a null text an empty one. Rows without a conv_id are one conversation. An empty table gives no row. Other
    columns are left out.

    Rows are formatted before the one exchange, by conv_id. A conversation is put together in one task, as text of at most 2 GB: its
    examples repeat its beginning, so their size grows with the square of its turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("plain"), _head(role).alias("head"), escaped(text).alias("body"))
    rows = rows.select(
        "conv_id", "turn", "role", "plain", F.concat("head", "body", F.lit(END)).alias("segment"), F.char_length("head").cast("long").alias("before"), F.char_length("body").cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("stop", F.sum(F.col("before") + F.col("size") + len(END)).over(order))
    turn = F.struct("stop", (F.col("role") == TARGET).alias("is_target"), "before", "size", "segment")
    found = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    found = found.withColumn("whole", F.array_join(F.transform("turns", lambda t: t["segment"]), ""))
    chosen = F.filter(
        F.transform("turns", lambda t, k: F.struct((k + 1).alias("n_turns"), (k + 1 == F.size("turns")).alias("is_whole"), t["is_target"].alias("is_target"), t["stop"].alias("stop"), t["size"].alias("size"))),
        lambda t: t["is_target"] | t["is_whole"],
    )
    each = found.select("conv_id", "whole", F.posexplode(chosen).alias("nth", "t"))
    stop = F.when(F.col("t.is_target"), F.col("t.stop") - len(END))
    return each.select(
        "conv_id", (F.col("nth") + 1).alias("example"), F.col("t.n_turns").cast("long").alias("n_turns"), "t.is_whole", F.substr("whole", F.lit(1), F.col("t.stop").cast("int")).alias("text"),
        (stop - F.col("t.size")).alias("loss_start"), stop.alias("loss_stop"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), as they were before they were formatted."""
    role = lambda p: unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), HEAD, 1))
    said = lambda p: unescaped(F.substr(p, F.instr(p, F.lit(HEAD)) + len(HEAD)))
    parts = F.filter(F.split(text, END.replace("|", r"\|")), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), said(p).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from `examples`: each conversation's turns as an array of (role, text), all text under
    the loss masks, unescaped, example by example, and the code points of all its examples.

    Only what an example adds is dealt: its reply, and the text of the one that is whole. As `examples` leaves each conversation in one
    task, nothing is dealt again if its result is read directly.
    """
    reply = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int")))
    added = examples.select("conv_id", F.when(F.col("loss_start").isNotNull(), F.struct("example", reply.alias("reply"))).alias("loss"), F.when(F.col("is_whole"), F.col("text")).alias("whole"), F.char_length("text").alias("chars"))
    found = added.groupBy("conv_id").agg(F.array_sort(F.collect_list("loss")).alias("losses"), F.element_at(F.collect_list("whole"), 1).alias("whole"), F.sum("chars").alias("formatted_chars"))
    return found.select("conv_id", parsed(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["reply"]), "").alias("loss_text"), "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its examples.

    turns_sha256 is of role, line feed, text and line feed of each turn, loss_sha256 of all text under the loss masks.
    """
    found = read_back(examples(conversations))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
