"""Sharding by a k-d tree over metadata of the documents.

A node is split along the dimension that is widest in it, at a weighted median of
all its documents, until each leaf has its share of the bytes. Medians come from
histograms that Spark aggregates and that are refined around the median, for all
nodes of a level at once; the driver sees 4096 sums per node at most.

A dimension is a long made of a metadata value (20 bits) and the hash of the text
(43 bits), so that any value can be cut, and equal texts always stay together.

Defined cases: a null text has no bytes and counts as the empty text; documents that
repeat a doc_id take slots of their own; an empty table gives an empty result. Sizes
of shards differ by no more than the groups of equal texts at the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.llm.common import prefix_sums, ranked, text_or_empty
from chatstrata.session import staged

HASH_BITS, VALUE_BITS, STEP_BITS = 43, 20, 12
ROW_BYTES = 8
# A cut may miss its median by this part of a shard, unless a single value is in the way.
TOLERANCE = 0.0002


@dataclass
class Node:
    """A leaf has a shard number; a split sends keys below `cut` to the left."""

    shards: int
    first: int
    dimension: str | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None

    def number(self, leaf, keys: dict[str, Column] | None = None) -> Column:
        """The leaf's number of a row, of which `keys` are the dimensions (by default its columns)."""
        if self.cut is None:
            return F.lit(leaf(self))
        key = keys[self.dimension] if keys else F.col(self.dimension)
        return F.when(key < F.lit(self.cut), self.left.number(leaf, keys)).otherwise(self.right.number(leaf, keys))


VALUES = ("size", "chars", "lines")
TEXT_VALUES = (*VALUES, "hash")


def text_values() -> dict[str, Column]:
    """The values of a document: bytes, characters, line breaks, and the hash of the text."""
    text = text_or_empty()
    return {
        "size": (F.octet_length(text) + ROW_BYTES).cast("long"),
        "chars": F.char_length(text).cast("long"),
        "lines": F.octet_length(F.regexp_replace(text, "[^\n]+", "")).cast("long"),
        "hash": F.xxhash64(text).bitwiseAND(F.lit((1 << HASH_BITS) - 1)),
    }


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text_crc32 and the values of each text."""
    crc = F.crc32(text_or_empty().cast("binary")).alias("text_crc32")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc, *[c.alias(n) for n, c in text_values().items()])


def value_bounds(rows: DataFrame) -> dict[str, tuple[int, int]]:
    found = rows.agg(*[f(v).alias(f"{n}_{v}") for v in VALUES for n, f in (("least", F.min), ("most", F.max))]).first()
    return {v: (found[f"least_{v}"] or 0, found[f"most_{v}"] or 0) for v in VALUES}


def keys_of(values: dict[str, Column], bounds: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """The sortable key of each dimension: the value, scaled to 20 bits of its range, before the hash."""
    top, keys = (1 << VALUE_BITS) - 1, {}
    for value in VALUES:
        low, high = bounds[value]
        scaled = F.floor((values[value] - low) * F.lit(top / max(1, high - low))).cast("long")
        keys[f"key_{value}"] = F.shiftleft(scaled, HASH_BITS).bitwiseOR(values["hash"])
    return keys


def _widest(rows: DataFrame, leaf_ids: Column, keys: list[str]) -> dict[int, tuple[str, int, int, int]]:
    """Per node: the dimension of the largest spread, its least and largest key, and the bytes of the node."""
    stats = rows.groupBy(leaf_ids.alias("node")).agg(
        F.sum("size").alias("bytes"), *[f(k).alias(f"{n}{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]
    )
    result = {}
    for row in stats.collect():
        best = max(keys, key=lambda k: (row[f"hi{k}"] >> HASH_BITS) - (row[f"lo{k}"] >> HASH_BITS))
        result[row["node"]] = (best, row[f"lo{best}"], row[f"hi{best}"] + 1, row["bytes"])
    return result


def _cuts(rows: DataFrame, leaf_ids: Column, wanted: dict[int, list]) -> dict[int, int]:
    """The key of each node at which the bytes before come nearest to what is wanted.

    wanted: dimension, least key, end of keys, bytes wanted on the left, tolerance.
    """
    open_nodes = {n: [d, lo, hi, goal, slack, 0] for n, (d, lo, hi, goal, slack) in wanted.items()}
    found: dict[int, int] = {}
    located = rows.withColumn("_node", leaf_ids)
    while open_nodes:
        # spans of a power of two keep all sums exact
        shifts = {n: max(0, (hi - lo - 1).bit_length() - STEP_BITS) for n, (_, lo, hi, *_) in open_nodes.items()}
        bucket, inside = F.lit(None).cast("long"), F.lit(False)
        for n, (d, lo, hi, *_) in open_nodes.items():
            mine = (F.col("_node") == n) & (F.col(d) >= F.lit(lo)) & (F.col(d) < F.lit(hi))
            bucket = F.when(mine, F.shiftright(F.col(d) - F.lit(lo), shifts[n])).otherwise(bucket)
            inside = inside | mine
        sums = located.where(inside).groupBy("_node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes")).collect()
        for n in list(open_nodes):
            d, lo, hi, goal, slack, before = open_nodes[n]
            for row in sorted((r for r in sums if r["_node"] == n), key=lambda r: r["bucket"]):
                start = lo + (row["bucket"] << shifts[n])
                if before + row["bytes"] >= goal:
                    break
                before += row["bytes"]
            else:
                found[n] = hi
                del open_nodes[n]
                continue
            end = min(hi, start + (1 << shifts[n]))
            under, over = goal - before, before + row["bytes"] - goal
            if min(under, over) <= slack or end - start == 1:
                found[n] = start if under <= over else end
                del open_nodes[n]
            else:
                open_nodes[n] = [d, start, end, goal, slack, before]
    return found


def kd_tree(rows: DataFrame, shards: int) -> Node:
    """The tree over `rows` (with keys); each node's bytes are split in proportion to its shards."""
    keys = [f"key_{v}" for v in VALUES]
    root = Node(shards, 0)
    leaves = [root]
    while any(leaf.shards > 1 for leaf in leaves):
        leaf_ids = root.number(lambda leaf: leaf.first)
        widest = _widest(rows, leaf_ids, keys)
        wanted = {}
        for leaf in leaves:
            if leaf.shards > 1 and leaf.first in widest:
                d, lo, hi, total = widest[leaf.first]
                share = total / leaf.shards
                wanted[leaf.first] = [d, lo, hi, share * (leaf.shards // 2), share * TOLERANCE]
        cuts = _cuts(rows, leaf_ids, wanted)
        after = []
        for leaf in leaves:
            if leaf.shards == 1:
                after.append(leaf)
                continue
            # a node without rows is split anywhere
            leaf.dimension, leaf.cut = (widest[leaf.first][0], cuts[leaf.first]) if leaf.first in cuts else (keys[0], 0)
            leaf.left = Node(leaf.shards // 2, leaf.first)
            leaf.right = Node(leaf.shards - leaf.shards // 2, leaf.first + leaf.shards // 2)
            after += [leaf.left, leaf.right]
        leaves = after
    return root


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    Either the number of shards or the bytes aimed at for each is given.
    """
    rows = staged(metadata(docs), "shard-metadata")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    keyed = rows.withColumns(keys_of({v: F.col(v) for v in TEXT_VALUES}, value_bounds(rows)))
    tree = kd_tree(keyed, shards)
    placed = keyed.select("doc_id", "size", "text_crc32", tree.number(lambda leaf: leaf.first).alias("shard"))
    ordered = ranked(placed, ["shard", "doc_id"], "shard-order")
    counts = ordered.groupBy("shard").agg(F.count("*").alias("_rows"))
    starts = prefix_sums(counts, "shard", "_rows", "_start").select("shard", "_start")
    return ordered.join(starts, "shard").withColumn("slot", F.col("position") - F.col("_start")).drop("position", "_start")


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """The documents, all columns but one named shard, in one folder per shard.

    The cuts are by values of the text, so a document's shard needs no join.
    """
    rows = staged(metadata(docs), "shard-metadata")
    bounds = value_bounds(rows)
    tree = kd_tree(rows.withColumns(keys_of({v: F.col(v) for v in TEXT_VALUES}, bounds)), shards)
    kept = [c for c in docs.columns if c.lower() != "shard"]
    shard = tree.number(lambda leaf: leaf.first, keys_of(text_values(), bounds))
    docs.select(*kept, shard.alias("shard")).repartitionByRange("shard", "doc_id").write.partitionBy("shard").parquet(path)
