"""Chat formatting by prefix-target expansion, in DataFrame functions only.

The template writes each turn as `[INST]role[/INST]text</s>` after one leading `<s>`. Inside roles and texts the control strings
and the escape character are replaced reversibly (`\\` by `\\0`, then `</s>`, `<s>`, `[INST]`, `[/INST]` by `\\1` to `\\4`), so the
markers in the output are exactly those that the template wrote.

A conversation's examples are prefixes of its formatted text: that of assistant turn n ends where turn n ends. Each assistant turn
is expanded into one row: its prefix (all turns before), its target, and the bounds of both and of the loss mask, which holds the
target's reply and end mark alone. The examples' texts together grow with the square of a conversation's turns; they are cut out of
the formatted text row by row, without a shuffle, so only what keeps them (`materialised`) takes that space.

A conversation is a unit here, as a text is: its turns meet in one row (its digest is that of its whole text). Rows are hashed to
partitions by conversation, and no row meets those of other conversations.

Defined results: texts of any length are kept whole; null text and null role count as empty; turns sort by turn (nulls first), ties by role and then text, and repeated
rows are turns each; a conversation without an assistant turn has no example but is formatted; a null conv_id is a conversation;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
_ESCAPES = (("\\", "\\0"), (END, "\\1"), (BEGIN, "\\2"), (OPEN, "\\3"), (CLOSE, "\\4"))


def escaped(c: Column) -> Column:
    for plain, mark in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    for plain, mark in reversed(_ESCAPES):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted: one text for each conversation."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("t"), F.coalesce(role_col, empty).alias("r"), F.coalesce(text_col, empty).alias("x")).alias("turn"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["r"]), F.lit(CLOSE), escaped(t["x"]), F.lit(END)))
    return one.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(line, "")).alias("formatted"))


def turns_back(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turn_no, start, role, reply_start, reply_end, end, text: the turns read back from the texts.

    Bounds are 0-based code points in the formatted text, end exclusive; role and text are unescaped."""
    parts = F.split(F.substring(F.col("formatted"), F.lit(len(BEGIN) + 1), F.char_length("formatted")), END, -1)
    rows = conversations.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("turn_no", "part"))
    size = F.char_length("part")
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    role = F.substring_index(F.substring(F.col("part"), F.lit(len(OPEN) + 1), size), CLOSE, 1)
    rows = rows.select("conv_id", "formatted_chars", F.col("turn_no").cast("long").alias("turn_no"), (F.coalesce(F.sum(size + len(END)).over(before), F.lit(0)) + len(BEGIN)).alias("start"), role.alias("role"), "part")
    head = len(OPEN) + len(CLOSE) + F.char_length("role")
    return rows.select(
        "conv_id",
        "formatted_chars",
        "turn_no",
        "start",
        unescaped(F.col("role")).alias("role"),
        (F.col("start") + head).alias("reply_start"),
        (F.col("start") + size).alias("reply_end"),
        (F.col("start") + size + len(END)).alias("end"),
        unescaped(F.substring(F.col("part"), head + 1, size)).alias("text"),
    )


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no, prefix, target, context_end, target_end, reply_start, reply_end, reply: one row for each assistant turn.

    The example is prefix and target: the formatted text up to target_end. Its context, all turns before, ends at context_end; under the
    loss mask is [reply_start, reply_end) and the end mark up to target_end. The reply is what the mask cuts out of the example's text."""
    parts = F.split(F.substring(F.col("formatted"), F.lit(len(BEGIN) + 1), F.char_length("formatted")), END, -1)
    rows = conversations.select("conv_id", "formatted", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("turn_no", "part"))
    role = F.substring_index(F.substring(F.col("part"), F.lit(len(OPEN) + 1), F.char_length("part")), CLOSE, 1)
    rows = rows.select("conv_id", "formatted", "turn_no", "part", role.alias("role")).where(unescaped(F.col("role")) == TRAINED)
    whole = F.concat(F.call_function("substring_index", F.col("formatted"), F.lit(END), F.col("turn_no") + 1), F.lit(END))
    rows = rows.select("conv_id", "turn_no", "part", "role", whole.alias("whole"), F.char_length(whole).alias("target_end"))
    rows = rows.withColumn("context_end", F.col("target_end") - F.char_length("part") - len(END))
    rows = rows.withColumns({"reply_start": F.col("context_end") + len(OPEN) + len(CLOSE) + F.char_length("role"), "reply_end": F.col("target_end") - len(END)})
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(
        "conv_id",
        long("turn_no"),
        F.substring(F.col("whole"), F.lit(1), F.col("context_end")).alias("prefix"),
        F.substring(F.col("whole"), F.col("context_end") + 1, F.col("target_end")).alias("target"),
        *map(long, ("context_end", "target_end", "reply_start", "reply_end")),
        unescaped(F.substring(F.col("whole"), F.col("reply_start") + 1, F.col("reply_end") - F.col("reply_start"))).alias("reply"),
    )


def materialised(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no, text, reply_start, reply_end: the examples with whole texts. Grows with the square of turns, if it is kept."""
    return examples(conversations).select("conv_id", "turn_no", F.concat("prefix", "target").alias("text"), "reply_start", "reply_end")


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the op8 contract, read back from the formatted texts; the loss is what the masks cut out of the examples' texts.

    An example's text is made where its row is, and only the reply goes on: time grows with the square of a conversation's turns, what is
    shuffled doesn't."""
    newline = F.lit("\n")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda t: t["x"]), "")
    rows = turns_back(conversations).select("conv_id", "formatted_chars", F.struct("turn_no", F.concat("role", newline, "text", newline).alias("x")).alias("turn"))
    one = rows.groupBy("conv_id").agg(F.max("formatted_chars").alias("formatted_chars"), F.count("*").alias("n_turns"), joined("turn").alias("all_turns"))
    masked = examples(conversations).select(F.col("conv_id").alias("c"), F.struct("turn_no", F.col("reply").alias("x")).alias("example"))
    both = one.join(masked.groupBy("c").agg(joined("example").alias("masked")), F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("loss", F.coalesce("masked", F.lit("")))
    return both.select("conv_id", "n_turns", F.sha2(F.col("all_turns").cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
