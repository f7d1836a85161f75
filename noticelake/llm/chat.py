"""Chat formatting from event logs, in DataFrame functions alone.

A log row is an event of a conversation: ``message`` starts a message, ``delta`` appends a
streamed part, ``edit`` replaces the text, ``regenerate`` starts the text anew (its own text
first, often empty), ``delete`` takes the message out.  Events fold in order of seq: what the
last message, edit or regenerate left, then the deltas behind it.

Messages fold first, each for itself, so a long conversation spreads over tasks; a conversation then
holds only its final texts.  One conversation is one output value, so its finished text must fit
in a task; nothing else does.

Template: ``<s>`` opens a conversation; turns read ``[SYS] t [/SYS]``, ``[INST] t [/INST]``,
``[ANS] t </s>`` for system, user and assistant, ``[TURN] role [AS] t [/TURN]`` for any other
role.  A control string inside a text gets one more backslash behind its first character
(``[INST]`` becomes ``[\\INST]``), so the way back removes one; texts that already hold
backslashes there keep theirs.  Assistant texts are the loss mask, given as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

_TAIL = r"(/?(?:INST|SYS|ANS|TURN|AS)\]|/?s>)"
ESCAPE, UNESCAPE = r"([\[<])(\\*)" + _TAIL, r"([\[<])\\(\\*)" + _TAIL
#: Fixed values of the template: role, opening, closing.
TURNS = (("system", "[SYS] ", " [/SYS]"), ("user", "[INST] ", " [/INST]"), ("assistant", "[ANS] ", " </s>"))
OTHER = ("[TURN] ", " [AS] ", " [/TURN]")
_LEXER = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[ANS\] .*? </s>|\[TURN\] .*? \[AS\] .*? \[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: conv_id, message_id, role, text.

    ``events``: conv_id, message_id, seq, kind, role, text.  Null text counts as empty, unknown
    kinds as message.  The role is that of the message's latest event that has one.  Events
    with equal seq fold in order of kind and text.  A message whose last starting event is a
    delete is left out, whatever deltas follow.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    starts = F.filter(F.transform("log", lambda e, i: F.when(F.coalesce(e["kind"], F.lit("")) != "delta", i)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_max(starts), F.lit(0))
    live = F.slice("log", first + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return grouped.where(~F.coalesce(F.get(F.col("log"), first)["kind"] == "delete", F.lit(False))).select(
        "conv_id",
        "message_id",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def _rendered(turn: Column) -> Column:
    """struct<piece, before, length>: the formatted turn, and where its text stands in it."""
    text = escape(turn["text"])

    def build(t: Column) -> Column:
        opening = F.concat(F.lit(OTHER[0]), escape(turn["role"]), F.lit(OTHER[1]))
        closing = F.lit(OTHER[2])
        for role, a, b in TURNS:
            opening = F.when(turn["role"] == role, F.lit(a)).otherwise(opening)
            closing = F.when(turn["role"] == role, F.lit(b)).otherwise(closing)
        return F.struct(
            F.concat(opening, t, closing).alias("piece"),
            F.length(opening).cast("long").alias("before"),
            F.length(t).cast("long").alias("length"),
            (turn["role"] == "assistant").alias("loss"),
        )

    return let(text, build)


def _spans(pieces: Column) -> Column:
    """Loss spans (start, length) in characters of the whole text, which opens with <s>."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    start = F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + p["before"]).alias("start"), p["length"].alias("length"))
        return F.struct(
            (state["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        ).cast(kind)

    return F.aggregate(pieces, start.cast(kind), step)["spans"]


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.  Messages go by message_id."""
    turn = F.struct("message_id", "role", "text")
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = grouped.select("conv_id", F.transform("turns", _rendered).alias("pieces"))
    joined = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))
    return pieces.select("conv_id", joined.alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""

    def turn(piece: Column) -> Column:
        found = F.lit(None).cast("struct<role:string,text:string>")
        head, between, tail = OTHER
        role = F.substring_index(F.substr(piece, F.lit(len(head) + 1)), between, 1)
        rest = len(head) + len(between)
        text = F.substr(piece, F.length(role) + rest + 1, F.length(piece) - F.length(role) - rest - len(tail))
        found = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        for name, a, b in TURNS:
            inner = F.substr(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))
            found = F.when(piece.startswith(a), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(found)
        return found

    return F.transform(F.regexp_extract_all(formatted, F.lit(_LEXER), F.lit(0)), turn)


def digests(formatted: DataFrame) -> DataFrame:
    """The query's columns, from formatted texts and loss spans alone."""
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log with one event a row.

    Rows go by turn; rows of the same turn by role, then text, each a message of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("long")
    return conversations.select(
        "conv_id", number.alias("message_id"), number.alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )


def as_streamed(messages: DataFrame) -> DataFrame:
    """The log of ``as_events`` as a service would have written it: every text arrives in steps.

    An assistant's answer streams in, is cut off half-way, and is regenerated in two parts; any other message
    is opened empty and then edited to its text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    step = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    streamed = F.array(step("message", F.lit("")), step("delta", first), step("regenerate", F.lit("")), step("delta", first), step("delta", rest))
    edited = F.array(step("message", F.lit("")), step("edit", text))
    steps = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    each = messages.select("conv_id", "message_id", F.col("seq").alias("at"), "role", F.posexplode(steps).alias("n", "e"))
    return each.select("conv_id", "message_id", (F.col("at") * 8 + F.col("n")).alias("seq"), "e.kind", "role", "e.text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats ``conversations`` and the conversation -7, from a log in which texts stream in, are edited and regenerated.

    Null text is empty, a null role is the empty role.  Empty table: conversation -7 alone.
    """
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return digests(render(fold(as_streamed(as_events(turns)))))


QUERIES = {"op2_chat": op2_chat}
ORACLES = {
    "op2_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|ANS|TURN|AS)\]|/?s>)', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
      ELSE 21 + length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|ANS|TURN|AS)\]|/?s>)', '\1\\\2\3', 'g')) END AS chars
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    3 + sum(chars) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
}
