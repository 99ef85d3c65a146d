"""Pattern packing of documents into token sequences by non-negative least squares.

Documents are tokenized and only those longer than a sequence are cut. The histogram of
piece lengths, 2048 counts at most, is all that the plan needs: patterns of up to three
length bins that fill a sequence are enumerated, their repeat counts are fitted to the
binned histogram by non-negative least squares and rounded down, and each pattern takes pieces
of its bins, the last one the longest that still fits. What is left over is packed best fit
decreasing, into the rests of the patterns first. Sequences of equal lengths are handled
as one run, so the plan's size depends on the lengths only.

Pieces get their place by their rank among the pieces of their length. Ranks are global
positions in the order of (length, piece), so no length is gathered in one task.

Defined cases: a null text is empty and has the end id alone. Documents that repeat are packed one by
one. An empty table gives no sequence.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chatstrata.llm.common import ranked
from chatstrata.llm.token_ids import encoder, tokenizer_path
from chatstrata.session import scratch_path

SEQUENCE = 2048
END_ID = 0
BINS = 128
DEPTH = 3


def tokenized(docs: DataFrame, path: str, end_id: int, length: int | None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of all documents, cut at `length`."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields)
    end = np.array([end_id], np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, held = [], 0
            for key, ids in zip(keys, words.encode(texts)):
                whole = np.concatenate([ids, end]).astype("<u4")
                step = length or len(whole)
                for piece, start in enumerate(range(0, len(whole), step)):
                    part = whole[start : start + step]
                    rows.append((key, piece, start, len(part), part.tobytes()))
                held += whole.nbytes
                if held > 1 << 23:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |columns @ x - target|, by the active-set method of Lawson and Hanson."""
    count = columns.shape[1]
    x, passive = np.zeros(count), np.zeros(count, bool)
    gram, pull = columns.T @ columns, columns.T @ target
    for _ in range(rounds):
        slope = pull - gram @ x
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if passive.all() or slope[best] <= 1e-7 * max(1.0, np.abs(pull).max()):
            break
        passive[best] = True
        while True:
            inside = np.flatnonzero(passive)
            solved = np.zeros(count)
            # a trace of ridge, as patterns may depend on each other
            solved[inside] = np.linalg.solve(gram[np.ix_(inside, inside)] + 1e-9 * np.eye(len(inside)), pull[inside])
            if (solved[inside] > 1e-12).all():
                x = solved
                break
            low = inside[solved[inside] <= 1e-12]
            gaps = x[low] - solved[low]
            ratio = np.min(np.where(gaps > 0, x[low] / np.where(gaps > 0, gaps, 1), 0))
            x = x + ratio * (solved - x)
            passive[inside[x[inside] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(bins: int = BINS, depth: int = DEPTH, used: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """Descending tuples of up to `depth` bin sizes (1 to bins) that add up to `bins`; only bins that are `used`."""
    sizes = [b for b in range(1, bins + 1) if used is None or used[b]]
    allowed, found = set(sizes), []
    for count in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(reversed(sizes), count - 1):
            last = bins - sum(head)
            if last in allowed and (not head or last <= head[-1]):
                found.append((*head, last))
    return found


@dataclass
class Plan:
    """Slots: `count` pieces of `length`, from the rank `first`, go to the sequences from `sequence` on, at `offset`."""

    size: int
    sequences: int = 0
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)
    # free tokens -> runs of sequences: (first sequence, number of sequences)
    rests: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.slots.append((length, rank, count, sequence, offset))
        self.taken[length] = rank + count

    def rest(self, free: int, sequence: int, count: int) -> None:
        if free and count:
            self.rests.setdefault(free, []).append((sequence, count))


def _take_patterns(plan: Plan, stock: np.ndarray, bins: int) -> None:
    size = plan.size
    width = -(-size // bins)
    bin_of = -(-np.arange(size + 1) // width)
    binned = np.bincount(bin_of, stock, minlength=bins + 1).astype(float)
    found = patterns(bins, DEPTH, binned > 0)
    if not found or not binned.any():
        return
    columns = np.zeros((bins + 1, len(found)))
    for i, pattern in enumerate(found):
        for b in pattern:
            columns[b, i] += 1
    repeats = np.floor(nnls(columns, binned) + 1e-6).astype(int)

    def longest(most: int, least: int) -> int:
        within = np.flatnonzero(stock[least : most + 1])
        return int(least + within[-1]) if len(within) else 0

    for i in sorted(np.flatnonzero(repeats), key=lambda i: found[i], reverse=True):
        left = int(repeats[i])
        while left:
            chosen: list[int] = []
            for place, b in enumerate(found[i]):
                last = place == len(found[i]) - 1 and place > 0
                most = size - sum(chosen) if last else b * width
                length = longest(most, max(1, (b - 1) * width + 1))
                if not length:
                    break
                chosen.append(length)
                stock[length] -= 1
            for length in chosen:
                stock[length] += 1
            if len(chosen) < len(found[i]):
                break
            need = {length: chosen.count(length) for length in chosen}
            count = min(left, *(int(stock[length]) // n for length, n in need.items()))
            if not count:
                break
            sequence, offset = plan.open(count), 0
            for length in chosen:
                plan.put(length, count, sequence, offset)
                stock[length] -= count
                offset += length
            plan.rest(size - offset, sequence, count)
            left -= count


def _take_rest(plan: Plan, stock: np.ndarray) -> None:
    """Best fit decreasing over runs of equal sequences."""
    size = plan.size
    free = np.zeros(size + 1, bool)
    free[list(plan.rests)] = True
    for length in range(size, 0, -1):
        left = int(stock[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = size // length
                whole, part = divmod(left, each)
                for count, held in ((whole, each), (1 if part else 0, part)):
                    if count:
                        sequence = plan.open(count)
                        for k in range(held):
                            plan.put(length, count, sequence, k * length)
                        if size - held * length:
                            plan.rest(size - held * length, sequence, count)
                            free[size - held * length] = True
                left = 0
                break
            room = int(length + fits[0])
            sequence, count = plan.rests[room].pop()
            used = min(count, left)
            plan.put(length, used, sequence, size - room)
            plan.rest(room, sequence + used, count - used)
            plan.rest(room - length, sequence, used)
            if room > length:
                free[room - length] = True
            free[room] = bool(plan.rests[room])
            left -= used
        stock[length] = 0


def plan_packing(histogram: dict[int, int], size: int = SEQUENCE, bins: int = BINS) -> Plan:
    """The plan of a histogram of piece lengths (1 to size)."""
    plan, stock = Plan(size), np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        stock[length] = count
    if stock[size]:
        plan.put(size, int(stock[size]), plan.open(int(stock[size])), 0)
        stock[size] = 0
    _take_patterns(plan, stock, bins)
    _take_rest(plan, stock)
    return plan


@dataclass
class Packing:
    """`pieces` has the ids of each piece, `placement` the sequence and offset of each; both by `key`."""

    pieces: DataFrame
    placement: DataFrame
    sequences: int

    def packed(self) -> DataFrame:
        """sequence_id, ids (one binary of 32-bit ids), documents: the sequences themselves."""
        rows = self.pieces.join(self.placement, "key")
        whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece"))).alias("_rows"))
        parts = F.transform("_rows", lambda r: r["ids"])
        return whole.select(
            "sequence_id",
            F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"),
            F.transform("_rows", lambda r: F.struct(r["doc_id"], r["piece"], r["offset"])).alias("documents"),
        )


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE) -> Packing:
    """All documents (doc_id, text) as pieces of at most `size` ids, each placed in a sequence of at most `size`."""
    spark = docs.sparkSession
    pieces = tokenized(docs, path or tokenizer_path(), end_id, size).withColumn("key", F.monotonically_increasing_id())
    folder = scratch_path(spark, "token-pieces")
    pieces.write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(pieces.schema).parquet(folder)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(histogram, size)
    starts, total = {}, 0
    for length in sorted(histogram):
        starts[length], total = total, total + histogram[length]
    slots = sorted((starts[length] + rank, sequence, offset) for length, rank, _, sequence, offset in plan.slots)
    shared = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 3))

    @pandas_udf("sequence_id long, offset long")
    def place(positions: pd.Series) -> pd.DataFrame:
        table = shared.value
        at = positions.to_numpy(np.int64)
        slot = np.searchsorted(table[:, 0], at, "right") - 1
        return pd.DataFrame({"sequence_id": table[slot, 1] + at - table[slot, 0], "offset": table[slot, 2]})

    order = ranked(pieces.select("length", "key"), ["length", "key"], "piece-order")
    placement = order.select("key", place("position").alias("_at")).select("key", "_at.*")
    return Packing(pieces, placement, plan.sequences)
