"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns before the reply as context and ends with the reply, which alone is trainable. Turns behind the last
reply of a conversation, or all of one without a reply, come in a closing example that has nothing to train. A turn is written as

    ### <role>: <text></turn>\\n

Inside texts a backslash is doubled and each control string gets one in its middle (`#\\## `, `<\\/turn>`); inside roles the
characters that end a header or a turn are written as `%` and their code. Both are undone without loss, so turns can be read back
from the formatted text alone: a turn ends at the only `</turn>` that a writer can have made.

Everything is a DataFrame expression. The turns of one conversation are gathered into one row, since an example is one string of
them; the expansion is a generator behind it and needs no further shuffle. What the method writes grows with turns times replies of
a conversation, one example at a time in memory.

Defined results: a null text or role counts as empty; turns are ordered by turn, role and text, nulls first, so ties and repeated
rows are all kept, in one fixed order; rows with a null conv_id are one conversation without an id; an empty table has no examples;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed control strings of the template.
TURN_START, HEADER_END, TURN_END = "### ", ": ", "</turn>"
TRAINABLE = "assistant"
_IN_TEXT = ((TURN_START, "#\\## "), (TURN_END, "<\\/turn>"))
_IN_ROLE = (("%", "%25"), (":", "%3A"), ("<", "%3C"))


def _swap(col: Column, pairs) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def escape(text: Column) -> Column:
    """`text` without any control string; backslashes are doubled first, so a single one is always an escape."""
    return _swap(text, (("\\", "\\\\"), *_IN_TEXT))


def unescape(text: Column) -> Column:
    return _swap(text, (*((new, old) for old, new in _IN_TEXT), ("\\\\", "\\")))


def escape_role(role: Column) -> Column:
    return _swap(role, _IN_ROLE)


def unescape_role(role: Column) -> Column:
    return _swap(role, [(new, old) for old, new in reversed(_IN_ROLE)])


def header(role: Column) -> Column:
    return F.concat(F.lit(TURN_START), escape_role(role), F.lit(HEADER_END))


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of a conversation in order, each with its role, header and escaped text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(
        (t["role"] == TRAINABLE).alias("reply"), header(t["role"]).alias("head"), escape(t["text"]).alias("body"))).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_examples, target, text, loss_start, loss_chars): one row per reply, in order, and the closing one.

    `target` is the position of the reply among the turns, from 0, and null in a closing example. `loss_start` and `loss_chars` are
    the code points of `text` that are trained on: the escaped reply, without its header and its end mark.
    """
    end = TURN_END + "\n"
    whole = gathered(conversations).select("conv_id", "turns", F.size("turns").alias("n"), F.transform(
        "turns", lambda t: F.concat(t["head"], t["body"], F.lit(end))).alias("parts"))
    at = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("turns", i - 1)["reply"] | (i == F.col("n")))
    targets = whole.withColumn("at", at)
    spread = targets.select("conv_id", "turns", "parts", F.size("at").alias("n_examples"), F.posexplode("at").alias("example", "last"))
    last = F.get("turns", F.col("last") - 1)
    context = F.array_join(F.slice("parts", F.lit(1), F.col("last") - 1), "")
    made = spread.select("conv_id", "example", "n_examples", "last", context.alias("context"), F.get("parts", F.col("last") - 1).alias("tail"), last["reply"].alias("reply"),
                         F.char_length(last["head"]).alias("head_chars"), F.char_length(last["body"]).alias("body_chars"))
    return made.select(
        "conv_id", "example", "n_examples", F.when(F.col("reply"), F.col("last") - 1).alias("target"), F.concat("context", "tail").alias("text"),
        (F.char_length("context") + F.col("head_chars")).alias("loss_start"), F.when(F.col("reply"), F.col("body_chars")).otherwise(0).alias("loss_chars"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), read from the marks alone."""
    pieces = F.split(text, TURN_END + "\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.locate(HEADER_END, piece)
        skip = len(TURN_START)
        return F.struct(unescape_role(F.substr(piece, F.lit(skip + 1), cut - (skip + 1))).alias("role"),
                        unescape(F.substr(piece, cut + len(HEADER_END))).alias("text"))

    return F.transform(pieces, turn)


def trained_on(text: Column, start: Column, chars: Column) -> Column:
    """What the loss mask covers, as the assistant said it."""
    return unescape(F.substr(text, start + 1, chars))


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: the count and digest of its turns (the last example holds all of them), the
    characters and digest of all that is trained on, and the characters written."""
    closing = F.col("example") == F.col("n_examples") - 1
    seen = rows.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), F.when(closing, turns_of(F.col("text"))).alias("turns"),
                       F.when(F.col("target").isNotNull(), trained_on(F.col("text"), F.col("loss_start"), F.col("loss_chars"))).alias("said"))
    said_in = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    short = seen.select("conv_id", "example", "chars", "said", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(said_in, 256)).alias("digest"))
    out = short.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.coalesce(F.sum(F.char_length("said").cast("long")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("example", "said")))).alias("said"))
    replies = F.concat_ws("", F.transform("said", lambda s: s["said"]))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", F.sha2(replies, 256).alias("loss_sha256"), "formatted_chars")
