"""Chat formatting by event-sourced reconstruction. Built-in functions only.

A log holds events (conv_id, seq, turn, kind, role, text). Kinds (null counts as message):
- message: sets role and text of its turn (a null role leaves the role);
- delta: appends its text to its turn;
- edit: replaces the text of its turn;
- regenerate: empties its turn (null text: to be streamed anew) and drops all earlier events of later turns, which may then be sent anew.
Only a message changes the role of a turn that has one; another event's role counts for a turn without. Events are dealt by conversation and sorted by
(seq, turn, kind, role, text); a null seq is earlier than all. A turn's text is the concatenation of what follows its last setting event, so each turn folds on
its own and no state grows with the conversation. A conversation's turns end up in one row, so one conversation has to fit a task.

Template: <turn role>\\n text </turn>\\n for each turn. Inside role and text the strings <turn and </turn and the escape
character \\ are escaped (\\ to \\b, the < of a control string to \\l), so a formatted conversation can be read back whatever it says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OPEN, CLOSE = "<turn ", "</turn>\n"
#: The role whose texts are trained on.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), r"<(/?turn)", r"\\l$1")


def unescape(text: Column) -> Column:
    """Undo escape(). In an escaped text every \\ is followed by b or l, so the two replacements cannot meet."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, role, text)) in turn order, one row per conversation.

    A null text is empty and a null role the empty role; a null conv_id is a conversation of its own; turns that are null come first and drop no others.
    Rows that repeat are events like any other: a repeated message sets the same text again, a repeated delta is said twice. Other columns are ignored; no
    events give no conversations.
    """
    e = events.select("conv_id", "turn", F.struct(F.col("seq"), F.col("turn"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("role"), F.col("text")).alias("e"))
    by_turn = e.repartition("conv_id").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"))
    again = F.array_max(F.transform(F.filter("log", lambda x: x["kind"] == "regenerate"), lambda x: x["seq"]))
    earlier_turns = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn")).rowsBetween(W.unboundedPreceding, -1)
    cut = F.max(F.when(F.col("turn").isNotNull(), again)).over(earlier_turns)
    live = by_turn.select("conv_id", "turn", "log", cut.alias("cut"))
    live = live.select("conv_id", "turn", F.when(F.col("cut").isNull(), F.col("log")).otherwise(F.filter("log", lambda x: x["seq"] >= F.col("cut"))).alias("log"))
    reset = F.array_max(F.filter(F.sequence(F.lit(0), F.size("log") - 1), lambda i: F.get("log", i)["kind"] != "delta"))
    text = F.array_join(F.transform(F.slice("log", F.coalesce(reset, F.lit(0)) + 1, F.size("log")), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    named = F.filter("log", lambda x: x["role"].isNotNull())
    said = F.filter("log", lambda x: x["role"].isNotNull() & (x["kind"] == "message"))
    role = F.coalesce(F.try_element_at(said, F.lit(-1))["role"], F.get(named, F.lit(0))["role"], F.lit(""))
    # collect_list leaves out the nulls of turns of which nothing is left
    turn = F.when(F.size("log") > 0, F.struct("turn", role.alias("role"), text.alias("text")))
    return live.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def escape_role(role: Column) -> Column:
    """As escape(), and on one line, since the line's end closes a role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans): the formatted text and the [start, length) of the learned texts in it, in code points."""
    parts = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(">\n")).alias("head"), escape(x["text"]).alias("body")))
    df = chats.select("conv_id", parts.alias("parts"))
    size = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(CLOSE)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.when(x["role"] == LEARNED, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"))
    formatted = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return df.select("conv_id", formatted.alias("formatted"), F.aggregate("parts", begin, step, lambda acc: acc["spans"]).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), learned: the text under the loss mask, formatted_chars) from what render() made."""
    pieces = F.slice(F.split("formatted", "(?s)(?:\\A|(?<=</turn>\n))<turn "), 2, 2**30)
    bare = F.transform(pieces, lambda p: F.substring_index(p, CLOSE, 1))
    turns = F.transform(bare, lambda p: F.struct(unescape_role(F.substring_index(p, ">\n", 1)).alias("role"), unescape(p.substr(F.char_length(F.substring_index(p, ">\n", 1)) + 3, F.char_length(p))).alias("text")))
    learned = F.array_join(F.transform("spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
