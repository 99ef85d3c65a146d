"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. All blocks of all texts are
sorted, and equal ones get one integer name. Then adjacent pairs of names are
sorted and named in the same way, until each document has one name. Names are
given by comparing the blocks themselves, so two documents have the same name
(of the same round) exactly if their texts are equal.

Defined cases: a null text counts as the empty text, which is one empty block. Rows
that repeat a doc_id are documents of their own; of those with the kept id the first
row stays. A null doc_id is smaller than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.llm.common import PARTITION_BIT, give_back, lower_ascii, text_or_empty, unused
from chatstrata.session import staged

BLOCK_BYTES = 4096
# A document on its way to one name: `row` tells documents apart, doc_id and digest travel with the first block.
CARRIED = "row long, doc_id long, digest string, n int, pos int"
CARRIED_NAMES = ("row", "doc_id", "digest", "n", "pos")
# Sort keys: a block of up to this size as it is, a longer one by so many bytes and a digest.
WHOLE_KEY_BYTES, PREFIX_BYTES = 48, 16


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names sorted blocks by the run of equal blocks they are in; `edge` keeps the block of the first and last row."""
    from pyspark import TaskContext

    give_back()
    base = TaskContext.get().partitionId() << PARTITION_BIT
    held, last, run, first = None, None, -1, True

    def finished(batch: pa.RecordBatch, edge: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], edge], names=batch.schema.names)

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(batch.schema.get_field_index("block"))
        head = pa.array([run < 0 or blocks[0].as_py() != last])
        tail = pc.not_equal(blocks.slice(1), blocks.slice(0, len(blocks) - 1))
        starts = pa.concat_arrays([head, tail]) if len(blocks) > 1 else head
        names = pc.add(pc.cumulative_sum(starts.cast(pa.int64())), pa.scalar(base + run, pa.int64()))
        run, last = names[-1].as_py() - base, blocks[-1].as_py()
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "block"]
        kept = [name for name in batch.schema.names if name != "block"]
        if held is not None:
            yield held
        edges = pa.array([blocks[0].as_py() if first else None] + [None] * (len(blocks) - 1), pa.binary())
        held = pa.RecordBatch.from_arrays([*columns, names, edges], names=[*kept, "name", "edge"])
        first = False
    if held is not None:
        edges = held.column(held.num_columns - 1).to_pylist()
        edges[-1] = last
        yield finished(held, pa.array(edges, pa.binary()))


def named(blocks: DataFrame, label: str) -> DataFrame:
    """`blocks` with the integer `name` of each distinct `block`.

    Long blocks are sorted by their first bytes and a digest, so that the rows sampled
    for the range exchange stay small; whether neighbours are equal is seen from the whole blocks.
    The sort key ends with row and pos, so a hot block is spread over several
    partitions. A block that goes on in the next partition is the last of one and
    the first of the other: both edges take the smaller name. There are two edges
    per partition, whatever the data.
    """
    short = F.concat(F.substring("block", 1, PREFIX_BYTES), F.unhex(F.sha2("block", 256)))
    keys = ["_key", "row", "pos"]
    keyed = blocks.withColumn("_key", F.when(F.octet_length("block") <= WHOLE_KEY_BYTES, F.col("block")).otherwise(short))
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*CARRIED_NAMES, "block")
    runs = staged(ordered.mapInArrow(_runs, f"{CARRIED}, name long, edge binary"), label)
    edges = runs.where("edge IS NOT NULL").select("edge", "name").distinct()
    origins = edges.groupBy("edge").agg(F.min("name").alias("origin"))
    moved = edges.join(origins, "edge").where("name != origin").select("name", "origin")
    return runs.drop("edge").join(moved, "name", "left").withColumn("name", F.coalesce("origin", "name")).drop("origin")


def blocks_of(docs: DataFrame, text: Column, block_bytes: int) -> DataFrame:
    body = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        text.cast("binary").alias("body"),
    )
    body = body.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))
    )
    exploded = body.select("row", "doc_id", "digest", "n", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return exploded.withColumns({"doc_id": F.when(first, F.col("doc_id")), "digest": F.when(first, F.col("digest"))})


def _pairs(names: DataFrame) -> DataFrame:
    """Adjacent names of the documents that have more than one, as the next round's blocks."""
    left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
    pairs = names.where("n > 1").groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("half"))
    return pairs.agg(
        F.max("doc_id").alias("doc_id"),
        F.max("digest").alias("digest"),
        F.concat_ws(",", left, right).cast("binary").alias("block"),
    ).select("row", "doc_id", "digest", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "block")


def identities(docs: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, doc_id, digest, step, name: one row per row of `docs`; (step, name) is the identity of its text."""
    current = staged(named(blocks_of(docs, text, block_bytes), "runs-0"), "names-0")
    longest = current.agg(F.max("n")).first()[0] or 1
    done = current.where("n = 1").withColumn("step", F.lit(0))
    step = 0
    while longest > 1:
        step, longest = step + 1, (longest + 1) // 2
        current = staged(named(_pairs(current), f"runs-{step}"), f"names-{step}")
        done = done.unionByName(current.where("n = 1").withColumn("step", F.lit(step)))
    return done.select("row", "doc_id", "digest", "step", "name")


def exact_groups(docs: DataFrame, text: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, digest (sha-256 of the compared text).

    `text` is the compared expression, by default the text with A-Z lower-cased.
    """
    text = lower_ascii(text_or_empty()) if text is None else text
    ids = identities(docs, text, block_bytes)
    groups = ids.groupBy("step", "name").agg(
        F.max(F.struct("doc_id", (-F.col("row")).alias("turned"))).alias("best"), F.count("*").alias("group_size")
    )
    # written, so that the join has an exchange of its own and Spark can split a large group
    groups = staged(groups.where("group_size > 1"), "exact-groups")
    grouped = F.col("group_size").isNotNull()
    return ids.join(groups, ["step", "name"], "left").select(
        "doc_id",
        F.when(grouped, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("row") == -F.col("best.turned"))).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    groups = staged(exact_groups(docs, block_bytes=block_bytes), "exact-groups")
    key = unused(docs, "_digest")
    kept = groups.where("kept").select("doc_id", "digest")
    keyed = docs.withColumn(key, F.sha2(lower_ascii(text_or_empty()).cast("binary"), 256))
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed[key] == kept["digest"])
    result = keyed.join(kept, same, "left_semi")
    repeated = groups.where("NOT kept AND doc_id <=> keep_id")
    if not repeated.isEmpty():
        result = result.dropDuplicates(["doc_id", key])
    return result.drop(key)
