"""Conversations: from log lines to messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions import jsonlines, text
from chatstrata.session import staged
from chatstrata.sources.scans import ROOT_PATTERN, scan_rollout_lines

CONVERSATION = ["root_id", "rel_path", "session_id"]


def is_event_line(line: Column) -> Column:
    return line.contains('"event_msg"') & (line.contains('"user_message"') | line.contains('"agent_message"'))


def is_response_line(line: Column) -> Column:
    return line.contains('"response_item"') & line.contains('"message"')


def is_message_line(line: Column) -> Column:
    """Cheap test for lines that may hold a message, before any JSON is parsed."""
    return is_event_line(line) | is_response_line(line)


def message_line_prefilter(lines: DataFrame) -> DataFrame:
    return lines.filter(is_message_line(F.col("line")))


def _message(value: Column, is_event: Column, line_no: Column, epoch_default: bool) -> Column:
    kind = jsonlines.field(value, "payload.type")
    stated = jsonlines.as_string(jsonlines.part(value, "payload.message"))
    event_role = F.when(kind.isin("user_message", "agent_message"), text.normalize_role(kind))
    speaker = jsonlines.field(value, "payload.role")
    response_role = F.when((kind == "message") & speaker.isin("user", "assistant"), text.normalize_role(speaker))
    body = F.when(is_event & (stated != ""), stated).otherwise(F.col("content_text"))
    return F.struct(
        is_event.alias("is_event"),
        F.concat(F.when(is_event, "event-").otherwise("response-"), line_no.cast("string")).alias("message_id"),
        F.when(is_event, event_role).otherwise(response_role).alias("role"),
        F.coalesce(jsonlines.field(value, "payload.phase"), F.lit("")).alias("phase"),
        text.parse_ts(jsonlines.field(value, "timestamp"), epoch_default).alias("ts"),
        text.strip(body).alias("text"),
    )


def _kept_message(epoch_default: bool) -> Column:
    """The message of a parsed line in an array, which is empty if it has no role or text."""
    message = _message(F.col("value"), F.col("event_line"), F.col("line_no"), epoch_default)
    return F.filter(F.array(message), lambda m: m["role"].isNotNull() & (m["text"] != ""))


def _parse(lines: DataFrame, kept: Column, carried: Sequence[str] = ()) -> DataFrame:
    # Each step is the input of a generator, which keeps the optimizer from
    # repeating the parsing in filters below.
    values = message_line_prefilter(lines).select(
        *CONVERSATION,
        *carried,
        "line_no",
        is_event_line(F.col("line")).alias("event_line"),
        F.explode(F.array(jsonlines.parse_line(F.col("line")))).alias("value"),
    )
    content = jsonlines.part(F.col("value"), "payload.content")
    values = values.withColumn("content_text", jsonlines.whole_text(content))
    return values.select(*CONVERSATION, *carried, "line_no", F.explode(kept).alias("message")).select(
        *CONVERSATION, *carried, "line_no", "message.*"
    )


def parse_messages(lines: DataFrame, epoch_default: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """Messages with a known role and some text, event and response ones alike, with the columns ``carried`` along."""
    return _parse(lines, _kept_message(epoch_default), carried)


def prefer_event_messages(messages: DataFrame, event_messages: DataFrame | None = None) -> DataFrame:
    """Event messages where a conversation has any, else its response messages.

    The conversations with events are found by a distinct that shrinks before
    the shuffle; no conversation is gathered in one place. ``event_messages``
    may name a cheaper source of the event messages.
    """
    events = messages.filter("is_event") if event_messages is None else event_messages
    with_events = events.select(*CONVERSATION).distinct().withColumn("has_events", F.lit(True))
    return (
        messages.join(with_events, CONVERSATION, "left").filter("is_event or has_events is null").drop("has_events")
    )


def conversation_messages(lines: DataFrame, epoch_default: bool = False) -> DataFrame:
    message = _kept_message(epoch_default)
    event_messages = _parse(lines.filter(is_event_line(F.col("line"))), message)
    return prefer_event_messages(_parse(lines, message), event_messages).drop("is_event")


def scan_conversations(spark: SparkSession, base: str | list[str], root_pattern: str = ROOT_PATTERN) -> DataFrame:
    """Messages of all session logs below ``base``.

    The parsed messages are staged, so the logs are parsed once for the messages and for
    the conversations that have events.
    """
    lines = scan_rollout_lines(spark, base, root_pattern, wanted=is_message_line)
    return prefer_event_messages(staged(parse_messages(lines), "messages")).drop("is_event")


def deep_lines(lines: DataFrame) -> DataFrame:
    """Message lines whose body is nested deeper than the unrolled levels, so that it is read in Arrow batches."""
    content = jsonlines.part(jsonlines.parse_line(F.col("line")), "payload.content")
    return message_line_prefilter(lines).filter(jsonlines.exceeds_depth(content))


def conversation_counts(messages: DataFrame, preview: int = C.PREVIEW_MESSAGES) -> DataFrame:
    counts = messages.groupBy(*CONVERSATION).agg(F.count("*").alias("message_count"))
    return counts.withColumn("preview_count", F.least("message_count", F.lit(preview).cast("bigint")))


def preview_messages(
    messages: DataFrame, n: int = C.PREVIEW_MESSAGES, limit: int = C.PREVIEW_CHARS, suffix: str = ""
) -> DataFrame:
    """First n messages of each conversation with their text cut."""
    in_order = W.partitionBy(*CONVERSATION).orderBy("line_no")
    return (
        messages.withColumn("nth", F.row_number().over(in_order))
        .filter(F.col("nth") <= n)
        .withColumn("text", text.clip_text(F.col("text"), limit, suffix))
    )
