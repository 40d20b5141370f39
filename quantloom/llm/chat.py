"""Operator 9: conversations rebuilt from event logs, rendered with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import read

#: Control strings of the template and what stands for each inside roles and texts; the escape sign comes first.
ESCAPES = (("~", "~0"), ("</s>", "~1"), ("<|", "~2"), ("|>", "~3"), ("[INST]", "~4"), ("[/INST]", "~5"))
END, OPEN, CLOSE = "</s>", "[INST] ", " [/INST]"
#: Kinds of events in the order in which events of one sequence number apply.
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    for control, stand in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(stand))
    return text


def unescape(text: Column) -> Column:
    for control, stand in reversed(ESCAPES):
        text = F.replace(text, F.lit(stand), F.lit(control))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log of events (conv_id, seq, kind, msg, role, text).

    message and edit replace what message msg held, delta appends to it, regenerate drops message msg and all
    later ones as they stood and starts msg anew. An unknown or null kind is a message. Events apply by seq,
    ties by kind (as KINDS), msg, role and text; a null seq comes first. A message's role is the last one given.
    Null texts are empty. Messages without a live event are gone. A null conv_id is a conversation.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0))
    rank = F.when(rank == 0, 1).otherwise(rank)
    log = events.select("conv_id", "seq", "msg", "role", F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    order = ["seq", "rank", "msg", "role", "text"]
    log = log.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    after = W.partitionBy("conv_id").orderBy(F.desc("nth")).rowsBetween(W.unboundedPreceding, -1)
    log = log.withColumn("regenerated", F.min(F.when(F.col("rank") == 2, F.col("msg"))).over(after))
    reset = F.max(F.when(F.col("rank") <= 3, F.col("nth"))).over(W.partitionBy("conv_id", "msg"))
    log = log.withColumn("reset", reset)
    log = log.withColumn("named", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("nth"))).over(W.partitionBy("conv_id", "msg")))
    gone = F.coalesce(F.col("regenerated") <= F.col("msg"), F.lit(False)) | F.coalesce(F.col("nth") < F.col("reset"), F.lit(False))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda p: p["text"])
    return log.filter(~gone).groupBy("conv_id", "msg").agg(F.first("named").alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and mask (turn from 0, start and length in that turn's piece) of each conversation.

    A turn is <|role|>, the text (a user's between [INST] and [/INST]) and </s>; the mask has assistant texts.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<|"), role, F.lit("|>"))
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    learnt = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = messages.select(
        "conv_id",
        "msg",
        F.concat(head, F.when(is_user, F.concat(F.lit(OPEN), text, F.lit(CLOSE))).otherwise(text), F.lit(END)).alias("piece"),
        F.when(learnt, F.struct(F.length(head).alias("start"), F.length(text).alias("length"))).alias("span"),
    )
    rows = F.array_sort(F.collect_list(F.struct("msg", "piece", "span")))
    held = turns.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.transform("rows", lambda r, i: F.struct(i.alias("turn"), r["span"]["start"].alias("start"), r["span"]["length"].alias("length")))
    return held.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(spans, lambda s: s["start"].isNotNull()).alias("mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "|>", 1)
        body = piece.substr(F.length(role) + 3, F.length(piece))
        wrapped = body.startswith(OPEN)
        body = F.when(wrapped, body.substr(F.lit(len(OPEN) + 1), F.length(body) - len(OPEN) - len(CLOSE))).otherwise(body)
        return F.struct(unescape(role.substr(F.lit(3), F.length(role))).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, cut from the formatted conversation's pieces."""
    pieces = F.split(formatted, END)
    return F.transform(mask, lambda s: unescape(F.get(pieces, s["turn"]).substr(s["start"] + 1, s["length"])))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted and mask of each conversation in a log of events (see fold and render).

    All work is by conversation: one shuffle on conv_id, windows and lists within it. Empty log: no rows.
    """
    return render(fold(events))


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: each row is a message of its own, in the order of turn, then role and text."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return conversations.select("conv_id", nth.alias("seq"), F.lit("message").alias("kind"), nth.alias("msg"), "role", "text")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :own), (-1L, 1L, 'assistant', :own) AS t(conv_id, turn, role, text)", {"own": own})
    out = format_chats(as_events(rows.unionByName(extra)))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("mask")), "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_COALESCED = "coalesce(text, '')"
_ESCAPED = "{0}"
for _control, _stand in ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_stand}')"

OP9_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, {_COALESCED} AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 8 + CASE WHEN role = 'user' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
