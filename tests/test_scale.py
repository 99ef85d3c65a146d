"""Plans that have to hold when one key has a third of all rows."""

import pytest
from pyspark.sql import functions as F

from chatstrata.operators import catalog, lines, messages, snapshots
from tests.test_operators import manifest


@pytest.fixture()
def small_skew_limits(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_hot_conversation_is_split(spark, small_skew_limits):
    session = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500)
    found = spark.range(0, 60000, 1, 8).select(
        F.lit(1).cast("bigint").alias("root_id"),
        F.concat(F.lit("sessions/"), session.cast("string")).alias("rel_path"),
        session.cast("string").alias("session_id"),
        F.col("id").alias("line_no"),
        (F.col("id") % 3 == 0).alias("is_event"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    chosen = messages.prefer_event_messages(found)
    assert "skew=true" in final_plan(chosen)
    with_events = {r.session_id for r in found.filter("is_event").select("session_id").distinct().collect()}
    expected = found.filter(F.col("is_event") | ~F.col("session_id").isin(list(with_events))).count()
    assert chosen.count() == expected


def window_limits(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit")


def test_repeats_are_dropped_before_the_shuffle(spark):
    rows = spark.range(0, 1000).select(
        F.lit(1).alias("root_id"), F.lit("history.jsonl").alias("rel_path"), F.col("id").alias("line_no"),
        (F.col("id") % 3).cast("string").alias("line"),
    )
    assert window_limits(lines.dedupe_ordered(rows)) == 2
    path = F.concat(F.lit("sessions/"), F.col("line_no").cast("string"), F.lit(".jsonl"))
    files = rows.select("root_id", F.col("line").alias("id"), path.alias("rel_path"), F.lit(1).alias("size_bytes"))
    assert window_limits(catalog.one_file_per_session(files)) == 2


def test_retention_ranks_only_the_newest(spark):
    frame = snapshots.apply_retention(manifest(spark, [("auto-protect", None), ("x", None)]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_scan_reads_only_the_columns_it_needs(spark, tmp_path):
    spark.range(3).select(
        F.lit(1).alias("root_id"), F.lit("sessions/a.jsonl").alias("rel_path"), F.lit("x").alias("id"),
        F.col("id").alias("size_bytes"), F.lit("y").alias("other"),
    ).write.parquet(f"{tmp_path}/files")
    plan = snapshots.file_counts(spark.read.parquet(f"{tmp_path}/files"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<root_id:int,rel_path:string>" in plan
    assert "StringEndsWith(rel_path,.jsonl)" in plan
