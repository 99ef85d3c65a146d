"""Messages of growing session logs: each line is parsed once, however often the logs are refreshed.

``growth.refresh`` reads what was appended into a feed; three streams take the feed into a store of tables that only grow:

- ``numbers``: the number of the first line of each span, by a state with the lines so far of every file. The state sees one
  row per span and never a line;
- ``messages``: the messages of the lines, with their place in the span;
- ``with_events``: each conversation that has an event, once, by the state of ``dropDuplicates``.

A conversation's first event takes back its response messages, so the choice between the two is left to ``messages``, which
joins the tables. Each stream continues from its checkpoint, so a lost job is run again and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from chatstrata.functions import paths
from chatstrata.operators import messages as spoken
from chatstrata.session import staged
from chatstrata.sources import growth, scans

FILE = growth.FILE
SPAN = [*FILE, "generation", "attempt", "start_byte"]
NUMBERS = (
    "root_id bigint, rel_path string, generation bigint, attempt string, start_byte bigint, n_lines bigint, first_line bigint"
)
MESSAGES = (
    "root_id bigint, rel_path string, session_id string, generation bigint, attempt string, start_byte bigint, nth bigint, "
    "is_event boolean, role string, phase string, ts timestamp, text string"
)
WITH_EVENTS = "root_id bigint, rel_path string, session_id string, generation bigint, attempt string, start_byte bigint"
STATE = "reached bigint, lines bigint"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _number_spans(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First line of each new span of a generation of a file; spans are few, as each stands for up to 64 MB."""
    reached, lines = state.get if state.exists else (0, 0)
    new = pd.concat(list(frames)).sort_values(["start_byte", "end_byte"])
    first = []
    for start, end, n in zip(new["start_byte"], new["end_byte"], new["n_lines"]):
        if start != reached:
            raise ValueError(f"{key}: a span begins at byte {start}, the last one ended at {reached}")
        first.append(lines)
        reached, lines = int(end), lines + int(n)
    state.update((reached, lines))
    yield new.assign(first_line=first)[_columns(NUMBERS)]


def _run(table: DataFrame, store: str, name: str) -> None:
    """Takes all that is new into one table of the store."""
    query = (
        table.writeStream.format("parquet")
        .option("path", f"{store}/{name}")
        .option("checkpointLocation", f"{store}/checkpoints/{name}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest(spark: SparkSession, feed: str, store: str) -> None:
    """Runs the streams over what the feed has got since the last call. One call at a time for a store."""
    if growth.spans(spark, feed).isEmpty():
        return
    spans = spark.readStream.schema(growth.SPANS).parquet(f"{feed}/spans")
    numbers = spans.groupBy(*FILE, "generation").applyInPandasWithState(
        _number_spans, NUMBERS, STATE, "append", GroupStateTimeout.NoTimeout
    )
    _run(numbers, store, "numbers")

    lines = spark.readStream.schema(f"{growth.READ}, attempt string").parquet(f"{feed}/lines").filter("line is not null")
    lines = lines.withColumn("session_id", paths.session_id_from_path(F.col("rel_path"))).withColumn("line_no", F.col("nth"))
    # The number of the line is not known here.
    found = spoken.parse_messages(lines, carried=["generation", "attempt", "start_byte"])
    _run(found.withColumnRenamed("line_no", "nth").select(*_columns(MESSAGES)), store, "messages")

    # With the attempt, lines that were never committed can be told apart; a span has one row at most.
    events = spark.readStream.schema(MESSAGES).parquet(f"{store}/messages").filter("is_event")
    _run(events.select(*_columns(WITH_EVENTS)).dropDuplicates(), store, "with_events")


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """A table of the store; a stream that had nothing to take wrote none."""
    try:
        return spark.read.schema(schema).parquet(f"{store}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def messages(spark: SparkSession, store: str) -> DataFrame:
    """The messages of all conversations ingested, as a scan of the logs gives them; no rows if nothing was ingested."""
    numbers = _table(spark, store, "numbers", NUMBERS)
    current = numbers.groupBy(*FILE).agg(F.max("generation").alias("generation"))
    known = staged(numbers.filter("n_lines > 0").join(current, [*FILE, "generation"], "left_semi"), "numbers")
    with_events = _table(spark, store, "with_events", WITH_EVENTS).join(known, SPAN, "left_semi")
    found = _table(spark, store, "messages", MESSAGES).join(known, SPAN)
    line_no = F.col("first_line") + F.col("nth")
    kind = F.when(F.col("is_event"), "event-").otherwise("response-")
    numbered = found.select(
        *spoken.CONVERSATION,
        line_no.alias("line_no"),
        "is_event",
        F.concat(kind, line_no.cast("string")).alias("message_id"),
        "role",
        "phase",
        "ts",
        "text",
    )
    return spoken.prefer_event_messages(numbered, with_events).drop("is_event")


def refresh(
    spark: SparkSession,
    base: str | list[str],
    store: str,
    root_pattern: str = scans.ROOT_PATTERN,
    chunk_bytes: int = growth.CHUNK_BYTES,
) -> DataFrame:
    """Brings the store up to date with the logs below ``base`` and returns its messages."""
    growth.refresh(spark, base, f"{store}/feed", root_pattern, chunk_bytes)
    ingest(spark, f"{store}/feed", store)
    return messages(spark, store)
