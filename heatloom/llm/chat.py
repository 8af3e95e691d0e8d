"""Chat transcripts rebuilt from event logs and rendered with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
#: Each character of the template's marks and the escape character itself, with what stands for it in a text.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turn_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Whole turns as events, a message each; turns of equal number, repeated rows too, stay apart, ordered by role and text.

    Null roles and texts stay null, null turns come first; other columns are ignored; an empty table gives no events.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).repartition("conv_id")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", seq.alias("seq"), seq.alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, pos, message_id, role, text) of a log (conv_id, seq, message_id, kind, role, text).

    By ``seq`` within a conversation: "message" and "delta" add their text to the message, "edit" puts its
    text in place of what was there, "regenerate" starts the message anew. A message stands where its
    first event stood, with the first role that it was given. The log is dealt by conversation
    once; a message's events are pared down before its text is put together.

    A null text is empty, a null or unknown kind is a delta, a null message_id makes the event a
    message of its own with others of its seq, a message without a role has the empty role. Events of equal seq go by kind
    and text; a repeated event happens twice. Null conv_ids are one conversation. A conversation's events must fit a
    task's memory. Other columns are ignored; an empty log gives no rows.
    """
    own = F.coalesce(F.col("message_id").cast("string"), F.concat(F.lit("#"), F.col("seq").cast("string")), F.lit("#"))
    log = events.select("conv_id", "seq", own.alias("message_id"), F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    message = Window.partitionBy("conv_id", "message_id")
    at = F.struct("seq", "kind", "text")
    anew = F.max(F.when(F.col("kind").isin("edit", "regenerate"), at)).over(message)
    log = log.select("*", at.alias("at"), anew.alias("anew"), F.min("seq").over(message).alias("pos"), F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(message).alias("named"))
    log = log.where(F.col("anew").isNull() | (F.col("at") >= F.col("anew")))
    messages = log.groupBy("conv_id", "message_id").agg(F.first("pos").alias("pos"), F.first("named").alias("named"), F.first("anew").alias("anew"), F.array_sort(F.collect_list("at")).alias("parts"))
    later = F.filter("parts", lambda p: F.col("anew").isNull() | (p > F.col("anew")))
    text = F.concat(F.coalesce("anew.text", F.lit("")), F.array_join(F.transform(later, lambda p: p["text"]), ""))
    return messages.select("conv_id", "pos", "message_id", F.coalesce("named.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (spans of code points of the assistant's texts) of each conversation.

    A turn reads ``<turn ROLE>TEXT</turn>`` and a line feed, with marks inside escaped. One conversation is
    one string, so it must fit a task's memory; all its steps share one dealing by conv_id. Roles and texts aren't null, as
    ``fold_events`` gives them; other columns are ignored.
    """
    head, body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)), escape(F.col("text"))
    rows = messages.select("conv_id", "pos", "message_id", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    before = Window.partitionBy("conv_id").orderBy("pos", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    piece = F.struct("pos", "message_id", F.concat("head", "body", F.lit(END)).alias("chunk"), "start", (F.col("start") + F.length("body")).alias("end"), "loss")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    mask = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["chunk"]), "").alias("formatted"), mask.alias("loss_mask"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Folds an event log and renders each conversation; see ``fold_events`` and ``render``. An empty log gives no rows."""
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text) and loss_texts, read from formatted and loss_mask alone; an empty string has no turns."""
    chunks = F.split("formatted", END)
    turns = F.transform(
        F.slice(chunks, F.lit(1), F.size(chunks) - 1),
        lambda c: F.struct(unescape(F.substring_index(F.substring(c, len(OPEN) + 1, 1 << 30), CLOSE, 1)).alias("role"), unescape(F.substring_index(c, CLOSE, -1)).alias("text")),
    )
    texts = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), texts.alias("loss_texts"))


def probe(spark: SparkSession, conv_id: int, text: str) -> DataFrame:
    """A conversation of a user's and an assistant's turn that both say ``text``."""
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
