r"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor walks the parts in order; text is escaped, every
other part becomes a placeholder ``<kind:number>`` and an attachment record (number, kind, reference, expanded tokens).

The template of a turn is ``<turn:ROLE>`` newline TEXT ``</turn>`` newline. Texts and roles are escaped, so that no
control string can occur inside them: ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``. Every
backslash of an escaped text starts an escape, so replacing ``\g``, ``\l`` and at last ``\b`` back is exact. A placeholder
is the only ``<`` in an escaped text, so it can't be confused with a text that says the same.

Everything that runs through a conversation (numbers of attachments, offsets) is a running sum over its rows, so the
work is in proportion to its turns and parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.session import table

PART = "struct<kind: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"

#: Expanded tokens of attachments: an image costs one token for each begun patch, audio and documents a rate.
IMAGE_PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 500
#: For attachments that don't state their extent.
UNKNOWN_TOKENS = 256


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of one text part; NULL text is an empty one."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("width"),
        null.cast("long").alias("height"), null.cast("double").alias("seconds"), null.cast("long").alias("pages"),
    ))


def expanded_tokens(part: Column) -> Column:
    """Tokens that the model sees in place of an attachment."""
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    known = (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", part["pages"] * DOCUMENT_TOKENS_PER_PAGE)
    )
    return F.coalesce(known, F.lit(UNKNOWN_TOKENS)).cast("long")


def _flat_turns(messages: DataFrame) -> DataFrame:
    """conv_id, n (the turn's number), role, flat text and attachment records of every message."""
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    rows = messages.select("conv_id", "turn", "role", "parts").withColumn("n", F.row_number().over(turn))
    parts = rows.select("conv_id", "n", F.coalesce("role", F.lit("")).alias("role"), F.posexplode_outer("parts").alias("at", "part"))
    is_text = F.col("at").isNull() | F.col("part.kind").eqNullSafe("text")
    earlier = Window.partitionBy("conv_id").orderBy("n", "at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("number", F.coalesce(F.sum(F.when(is_text, 0).otherwise(1)).over(earlier), F.lit(0)).cast("int"))
    label = F.concat(F.lit("<"), escape(F.coalesce("part.kind", F.lit("unknown"))), F.lit(":"), F.col("number").cast("string"), F.lit(">"))
    piece = F.when(is_text, escape(F.coalesce("part.text", F.lit("")))).otherwise(label)
    record = F.when(~is_text, F.struct("number", F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"), expanded_tokens(F.col("part")).alias("tokens")))
    one = parts.select("conv_id", "n", "role", "at", piece.alias("piece"), record.alias("record"))
    return one.groupBy("conv_id", "n", "role").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("at", "piece")))["piece"], "").alias("flat"),
        F.sort_array(F.collect_list("record")).alias("attached"),
    )


def format_chats(messages: DataFrame, mask_role: str = "assistant") -> DataFrame:
    """Conversations from ``messages`` (conv_id, turn, role, parts); one row for each conv_id.

    Turns stand by turn, then role and parts, so ties and repeated rows have one order; NULL turns come first. NULL roles
    and texts are empty; a message without parts is an empty turn; a NULL part is an attachment of unknown kind; NULL
    is a conversation of its own; an empty table gives an empty result. Other columns are not read. A conversation is one
    string, so it has to fit a task.

    Returns conv_id, formatted, spans (start and length of each text under the loss mask, those of ``mask_role``, in code
    points, and byte_start and byte_length in UTF-8), attachments, attachment_tokens. Built-in functions only.
    """
    head, tail = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n")), F.lit("</turn>\n")
    turns = _flat_turns(messages).withColumn("said", F.concat(head, "flat", tail))
    earlier = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda size: F.coalesce(F.sum(size("said").cast("long")).over(earlier), F.lit(0)) + size(head)
    span = F.struct(
        begins(F.char_length).alias("start"), F.char_length("flat").cast("long").alias("length"),
        begins(F.octet_length).alias("byte_start"), F.octet_length("flat").cast("long").alias("byte_length"),
    )
    rows = turns.select("conv_id", "n", "said", F.when(F.col("role") == mask_role, span).alias("span"), "attached")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "said"))).alias("turns"), F.sort_array(F.collect_list("span")).alias("spans"), F.sort_array(F.collect_list(F.struct("n", "attached"))).alias("attached"))
    attachments = F.flatten(F.col("attached")["attached"])
    return chats.select(
        "conv_id", F.array_join(F.col("turns")["said"], "").alias("formatted"), "spans", attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _pieces() -> Column:
    """The turns as they stand in the formatted text, without their ends."""
    return F.slice(F.split("formatted", "</turn>\n"), F.lit(1), F.size(F.split("formatted", "</turn>\n")) - 1)


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: adds ``turns`` (role, text; placeholders stand as text) and ``loss_text``,
    what the spans mark, unescaped. A conversation always has a turn; an empty table gives an empty result. ``parse_parts``
    tells placeholders from texts."""
    turns = F.transform(_pieces(), lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, ">\n", 1), F.lit(len("<turn:") + 1))).alias("role"),
        unescape(F.substr(p, F.instr(p, ">\n") + 2)).alias("text"),
    ))
    cut = lambda data, s: F.substr(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")
    marked = _let(F.col("formatted").cast("binary"), lambda data: F.transform("spans", lambda s: unescape(cut(data, s))))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(marked, ""))


def parse_parts(chats: DataFrame) -> DataFrame:
    """Read the parts of formatted conversations back: adds ``parts``, for each turn an array of (kind, text, number). A text
    has no number, a placeholder no text but the number of its attachment. Neighbouring texts are one; empty ones aren't
    there. An attachment without kind is of kind ``unknown``; one of kind ``text`` can't be."""

    def part(p: Column) -> Column:
        label = F.substr(p, F.lit(2), F.char_length(p) - 2)
        number = F.substring_index(label, ":", -1)
        kind = F.substr(label, F.lit(1), F.char_length(label) - F.char_length(number) - 1)
        return F.struct(
            F.when(p.startswith("<"), unescape(kind)).otherwise("text").alias("kind"), F.when(~p.startswith("<"), unescape(p)).alias("text"),
            F.when(p.startswith("<"), number.try_cast("int")).alias("number"),
        )

    said = lambda p: F.substr(p, F.instr(p, ">\n") + 2)
    return chats.withColumn("parts", F.transform(_pieces(), lambda p: F.transform(F.regexp_extract_all(said(p), F.lit("<[^<>]*>|[^<>]+"), F.lit(0)), part)))


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of a query, all from the formatted output: one row for each row of ``chats``, so repeated ones are
    digested each; an empty table gives an empty result."""
    back = parse_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: Both texts of the conversation that tries the escapes.
TRIAL = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trial = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL).alias("text"))
    messages = rows.unionByName(trial).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return digests(format_chats(messages))


ORACLE = r"""
WITH m AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 16 + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
