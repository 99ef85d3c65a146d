"""Removal of long repeated strings with sparse suffix arrays in a logarithmic index.

A byte goes if it is covered by a string of MATCH bytes that also starts in a document of a
smaller doc_id. Every window of MATCH bytes has an anchor: the first of its GRAM-byte strings whose
hash is least. Equal windows have equal anchors in the same place, so only suffixes at anchors are indexed.

1. The anchors' hashes of each batch of documents are dealt out by hash; those of a single document
   need no more. A batch sends each hash once, however many of its documents have it.
2. The other anchors are sent with the bytes around them, equal ones of a batch once. Each share of the hashes
   is a logarithmic index: a new batch gets its suffix array, levels of about equal size are merged,
   and a merge scans the two for equal windows. A window's class is that of its suffix at its depth in the suffix array
   with that of its (reversed) left part, both from longest common prefixes: bytes are compared, not hashes.
   Only windows that are like a neighbour's in both arrays and not known to be gone are sorted by class.
   An anchor whose windows all start in a smaller document too leaves the index.
3. The windows found are joined to the documents, whose remaining bytes are put together.

The documents are written once as a table bucketed by row, in the shared folder, so that neither of the two
joins moves a text.

Defined cases: a null text is empty; a text shorter than MATCH loses nothing. A null doc_id is smaller than any
other. Rows of the same doc_id do not take from each other. An empty table gives an empty result. Texts are
cut into stretches that overlap by MATCH - 1 bytes, so long ones take no more memory there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstrata.llm.byte_text import mixed, powers
from chatstrata.llm.common import give_back
from chatstrata.session import scratch_path, small_batches, staged

MATCH, GRAM = 50, 20
LEFT = MATCH - GRAM
WINDOWS = LEFT + 1
CONTEXT = LEFT + MATCH
STRETCH = 1 << 20
PLACE_BITS = 21
NO_ID = -(1 << 63)
# What is sent to a share of the hashes, and what passes through it on the way to documents.
FOR_SHARE, FOR_ROWS = 0, 1
# A share of the hashes is meant for so many bytes of text; a batch is closed at so many anchors.
SHARE_BYTES = 1 << 26
BATCH_ANCHORS = 1 << 21
LEVEL_RECORDS = 1 << 16


def stretches(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, documents, offsets): buffers of parts of documents; a part's windows are all its own."""
    parts: list[bytes] = []
    owners: list[int] = []
    offsets: list[int] = []
    size = 0

    def joined():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, np.array(owners), np.array(offsets)

    for number, body in enumerate(bodies):
        for at in range(0, max(1, len(body) - MATCH + 1), STRETCH):
            part = body[at : at + STRETCH + MATCH - 1]
            if len(part) < MATCH:
                continue
            if parts and size + len(part) > STRETCH:
                yield joined()
                parts, owners, offsets, size = [], [], [], 0
            parts.append(part)
            owners.append(number)
            offsets.append(at)
            size += len(part)
    if parts:
        yield joined()


@dataclass
class Anchors:
    """Anchors of a buffer: place in it, hash, first and last start of their windows, and the part they are in."""

    place: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    part: np.ndarray


def anchors(buffer: np.ndarray, starts: np.ndarray) -> Anchors:
    up, down = powers(len(buffer) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(buffer) - GRAM + 1])
    # the first of equal hashes is the least
    places = np.uint64((1 << PLACE_BITS) - 1)
    least, width = (grams & ~places) | np.arange(len(grams), dtype=np.uint64), 1
    while width * 2 <= WINDOWS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOWS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    # windows that reach into the next part are of no document
    ends = np.append(starts[1:], len(buffer))
    inside = np.ones(len(buffer), bool)
    inside[ends[:, None] - np.arange(1, MATCH)] = False
    inside = inside[: len(least)]
    new = least[1:] != least[:-1]
    begin = np.flatnonzero(inside & np.concatenate([[True], new | ~inside[:-1]]))
    finish = np.flatnonzero(inside & np.concatenate([new | ~inside[1:], [True]]))
    at = (least[begin] & places).astype(np.int64)
    return Anchors(at, grams[at], begin, finish, np.searchsorted(starts, at, "right") - 1)


def _body(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _share(hashes: np.ndarray, shares: int) -> np.ndarray:
    return (hashes % np.uint64(shares)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; the list is left empty, so that they are not held twice."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def _order_by(key: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The order by two numbers; the second is looked at only where the first is equal."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.append(same, False) | np.append(False, same)
    rows = order[tied]
    order[tied] = rows[np.lexsort((then[rows], key[tied]))]
    return order


# Step 1: which anchors are in several documents.

SENT = "share int, kind int, values binary, rows binary"
FOUND_BY_BUCKET = "bucket int, values binary, rows binary"


def _send_hashes(shares: int):
    """Rows for a share: the batch's hashes with one document each; rows for a document: what it is known to share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            bodies = [_body(t) for t in batch.column(1).to_pylist()]
            for buffer, starts, owners, _ in stretches(bodies):
                found = anchors(buffer, starts)
                hashes.append(found.hash)
                rows.append(numbers[owners[found.part]])
                if sum(map(len, hashes)) >= BATCH_ANCHORS:
                    yield from sent(_taken(hashes), _taken(rows))
                    give_back()
        if hashes:
            yield from sent(_taken(hashes), _taken(rows))
        give_back()

    def sent(hashes: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        share, low = _share(hashes, shares), _low(hashes)
        order = _order_by((share << 32) | low, rows)
        share, low, rows = share[order], low[order], rows[order]
        again = np.concatenate([[False], (share[1:] == share[:-1]) & (low[1:] == low[:-1])])
        once = ~again | np.concatenate([[True], rows[1:] != rows[:-1]])
        share, low, rows, again = share[once], low[once], rows[once], again[once]
        first = np.flatnonzero(~again)
        many = np.repeat(np.diff(np.append(first, len(low))) > 1, np.diff(np.append(first, len(low))))
        yield _sent(FOR_SHARE, share[first], low[first], rows[first])
        if many.any():
            yield _sent(FOR_ROWS, rows[many] % shares, low[many], rows[many])

    return send


def _dealt(number: np.ndarray, values: np.ndarray, rows: np.ndarray | None) -> tuple[list, list, list]:
    """For each number: it, and its values and rows as bytes."""
    order = np.argsort(number, kind="stable")
    number, values = number[order], values[order]
    rows = None if rows is None else rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    spans = list(zip(cuts, np.append(cuts[1:], len(number))))
    packed = [None if rows is None else rows[a:b].tobytes() for a, b in spans]
    return number[cuts].tolist(), [values[a:b].tobytes() for a, b in spans], packed


def _sent(kind: int, share: np.ndarray, values: np.ndarray, rows: np.ndarray | None) -> pa.RecordBatch:
    numbers, packed, packed_rows = _dealt(share, values, rows)
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [numbers, [kind] * len(numbers), packed, packed_rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["share", "kind", "values", "rows"])


def _by_bucket(values: np.ndarray, rows: np.ndarray, buckets: int) -> pd.DataFrame:
    """What was found, packed for buckets of documents, so that there is no row for each share and document."""
    numbers, packed, packed_rows = _dealt(rows % buckets, values, rows)
    return pd.DataFrame({"bucket": np.array(numbers, np.int32), "values": packed, "rows": packed_rows})


def _passing(batch: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    known = batch[batch["kind"] == FOR_ROWS]
    return np.frombuffer(b"".join(known["values"]), kind), np.frombuffer(b"".join(known["rows"]), np.int64)


def _shared_hashes(buckets: int):
    """The hashes of a share that several batches sent, by document; what batches knew already goes along."""

    def shared(batch: pd.DataFrame) -> pd.DataFrame:
        sent = batch[batch["kind"] == FOR_SHARE]
        low = np.frombuffer(b"".join(sent["values"]), np.uint32)
        rows = np.frombuffer(b"".join(sent["rows"]), np.int64)
        order = np.argsort(low, kind="stable")
        low, rows = low[order], rows[order]
        same = low[1:] == low[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(low) else np.zeros(0, bool)
        values, known = _passing(batch, np.dtype(np.uint32))
        return _by_bucket(np.concatenate([values, low[many]]), np.concatenate([known, rows[many]]), buckets)

    return shared


def _documents_of(kind: np.dtype):
    """A bucket's documents, each with all that was found for it."""

    def regrouped(batch: pd.DataFrame) -> pd.DataFrame:
        values, rows = np.frombuffer(b"".join(batch["values"]), kind), np.frombuffer(b"".join(batch["rows"]), np.int64)
        numbers, packed, _ = _dealt(rows, values, None)
        return pd.DataFrame({"row": np.array(numbers, np.int64), "found": packed})

    return regrouped


# Step 2: which windows of these anchors start in a smaller document too.

RECORD = np.dtype([("bytes", np.uint8, CONTEXT), ("first", np.int8), ("last", np.int8), ("doc", np.int64), ("row", np.int64), ("place", np.int64)])
FOUND = np.dtype([("place", np.int64), ("windows", np.uint32)])


def _numbers(values: np.ndarray) -> np.ndarray:
    """Each value's number in the order of the values, from 0; equal ones have the same."""
    order = np.argsort(values)
    values = values[order]
    numbers = np.zeros(len(order), np.int64)
    numbers[order[1:]] = np.cumsum(values[1:] != values[:-1])
    return numbers


def _order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of bytes, and the common prefix of each with the one before in it.

    Sorted by the first eight bytes; runs that are equal so far are sorted by the next eight, until none is left.
    """
    width = -(-text.shape[1] // 8) * 8
    wide = np.zeros((len(text), width), np.uint8)
    wide[:, : text.shape[1]] = text
    words = wide.view(">u8").T
    first = words[0].astype(np.uint64)
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    for word in words[1:]:
        at = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(at):
            break
        rows = order[at]
        key = (np.cumsum(new[at]) << 32) | _numbers(word[rows].astype(np.uint64))
        by = np.argsort(key)
        order[at], key = rows[by], key[by]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
    ordered = text[order]
    common = np.where(new[1:], (ordered[1:] != ordered[:-1]).argmax(axis=1), text.shape[1])
    return order, np.concatenate([[0], common]).astype(np.int8)


def _like_before(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a suffix array have the first `depth` bytes of the one before, and which those of a neighbour."""
    same = common >= depth
    same[0] = False
    return same, same | np.append(same[1:], False)


def scan(records: np.ndarray, gone: np.ndarray) -> None:
    """Marks in `gone` (bit i: the window LEFT - i before the anchor) the windows that a smaller document has.

    Windows marked before are left out: the smallest document of a window is never marked, so it is still there.
    """
    if len(records) < 2:
        return
    right, right_common = _order(records["bytes"][:, LEFT:])
    left, left_common = _order(records["bytes"][:, :LEFT][:, ::-1])
    # from here on rows are in the order of `right`
    place = np.empty(len(right), np.int64)
    place[right] = np.arange(len(right))
    left = place[left]
    first, last, doc, marks = records["first"][right], records["last"][right], records["doc"][right], gone[right]
    reached, left_class = np.empty(len(right), bool), np.empty(len(right), np.int64)
    for back in range(WINDOWS):
        bit = LEFT - back
        mark = np.uint32(1 << bit)
        same, alike = _like_before(right_common, MATCH - back)
        own = alike & (first <= bit) & (last >= bit) & ((marks & mark) == 0)
        if back:
            left_same, alike = _like_before(left_common, back)
            reached[left] = alike
            own &= reached
        own = np.flatnonzero(own)
        if len(own) < 2:
            continue
        key = np.cumsum(~same)[own]
        if back:
            left_class[left] = np.cumsum(~left_same)
            key = (key << 32) | left_class[own]
            order = np.argsort(key)
            own, key = own[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[own], begin), np.diff(np.append(begin, len(own))))
        marks[own[doc[own] > least]] |= mark
    gone[right] = marks


def _all_windows(records: np.ndarray) -> np.ndarray:
    ones = (np.uint64(1) << (records["last"] + 1).astype(np.uint64)) - (np.uint64(1) << records["first"].astype(np.uint64))
    return ones.astype(np.uint32)


class LogarithmicIndex:
    """Levels of sparse suffix arrays; equal-sized ones merge, and matches are found while merging."""

    def __init__(self, level_records: int = LEVEL_RECORDS):
        self.level_records = level_records
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, records: np.ndarray) -> None:
        self.waiting.append(records)
        self.size += len(records)
        if self.size >= self.level_records:
            self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        records = np.concatenate(self.waiting)
        self.waiting, self.size = [], 0
        level = self._scanned(records, np.zeros(len(records), np.uint32))
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merged(self.levels.pop(), level)
        self.levels.append(level)

    def _merged(self, one, other) -> tuple[np.ndarray, np.ndarray]:
        return self._scanned(np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]]))

    def _scanned(self, records: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scan(records, gone)
        whole = (gone & _all_windows(records)) == _all_windows(records)
        self.done.append((records[whole], gone[whole]))
        return records[~whole], gone[~whole]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The records with a window that starts in a smaller document, and these windows."""
        self._settle()
        while len(self.levels) > 1:
            other = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), other))
        found = [(r[g > 0], g[g > 0]) for r, g in [*self.done, *self.levels]]
        if not found:
            return np.zeros(0, RECORD), np.zeros(0, np.uint32)
        return np.concatenate([r for r, _ in found]), np.concatenate([g for _, g in found])


def _send_records(shares: int):
    """Rows for a share: the records of a batch, equal ones once; rows for a document: windows that the batch knows to be gone."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for batch in batches:
            rows, ids, texts, wanted = (batch.column(i) for i in range(4))
            rows = rows.to_numpy()
            ids = ids.fill_null(NO_ID).to_numpy()
            flags = wanted.to_pylist()
            chosen = [i for i, w in enumerate(flags) if w]
            if not chosen:
                continue
            # (place in `chosen`, hash), one number each
            marks = [np.frombuffer(flags[i], np.uint32) for i in chosen]
            marks = np.sort((np.repeat(np.arange(len(marks)), list(map(len, marks))) << 32) | np.concatenate(marks))
            bodies = [_body(texts[i].as_py()) for i in chosen]
            for buffer, starts, owners, offsets in stretches(bodies):
                found = anchors(buffer, starts)
                sought = (owners[found.part] << 32) | _low(found.hash)
                keep = marks[np.minimum(np.searchsorted(marks, sought), len(marks) - 1)] == sought
                if not keep.any():
                    continue
                place, part = found.place[keep], found.part[keep]
                records = np.zeros(int(keep.sum()), RECORD)
                padded = np.concatenate([np.zeros(LEFT, np.uint8), buffer, np.zeros(MATCH, np.uint8)])
                records["bytes"] = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[place]
                # nothing of another document, as equal records are sent once
                begin, end = starts[part], np.append(starts[1:], len(buffer))[part]
                edge = np.flatnonzero((place - LEFT < begin) | (place + MATCH > end))
                at = place[edge, None] + np.arange(-LEFT, MATCH)
                records["bytes"][edge] *= (at >= begin[edge, None]) & (at < end[edge, None])
                records["first"] = LEFT - (place - found.first[keep])
                records["last"] = LEFT - (place - found.last[keep])
                documents = np.array(chosen)[owners[part]]
                records["row"], records["doc"] = rows[documents], ids[documents]
                records["place"] = place - starts[part] + offsets[part]
                held.append(records)
                hashes.append(found.hash[keep])
                if sum(map(len, held)) >= BATCH_ANCHORS // 8:
                    yield from sent(_taken(held), _taken(hashes))
                    give_back()
        if held:
            yield from sent(_taken(held), _taken(hashes))
        give_back()

    def sent(records: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        # equal records have equal anchors and bytes; the one of the smallest document is sent
        bytes_ = np.ascontiguousarray(records["bytes"]).view(np.uint64)
        # brings equal records together; whether they are equal is decided on their bytes
        blend = mixed((records["first"].astype(np.uint64) << np.uint64(8)) | records["last"].astype(np.uint64))
        for word in bytes_.T:
            blend = mixed(blend ^ word)
        order = _order_by(hashes, blend)
        records, hashes, bytes_ = records[order], hashes[order], bytes_[order]
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        for part in (bytes_, records["first"][:, None], records["last"][:, None]):
            same[1:] &= (part[1:] == part[:-1]).all(axis=1)
        begin = np.flatnonzero(~same)
        least = np.minimum.reduceat(records["doc"], begin)[np.cumsum(~same) - 1]
        # rows of the same document must all be answered
        sending = records["doc"] == least
        gone = records[~sending]
        yield _sent(FOR_SHARE, _share(hashes[sending], shares), records[sending], None)
        if len(gone):
            found = np.zeros(len(gone), FOUND)
            found["place"], found["windows"] = gone["place"], _all_windows(gone)
            yield _sent(FOR_ROWS, gone["row"] % shares, found, gone["row"])

    return send


def _repeated_windows(buckets: int):
    """The windows of a share that start in a smaller document too, by document; what batches knew already goes along."""

    def repeated(batch: pd.DataFrame) -> pd.DataFrame:
        index = LogarithmicIndex()
        for run in batch.loc[batch["kind"] == FOR_SHARE, "values"]:
            index.add(np.frombuffer(run, RECORD))
        records, gone = index.finish()
        found = np.zeros(len(records), FOUND)
        found["place"], found["windows"] = records["place"], gone
        rows = records["row"].copy()
        del index, records, gone
        give_back()
        values, known = _passing(batch, FOUND)
        return _by_bucket(np.concatenate([values, found]), np.concatenate([known, rows]), buckets)

    return repeated


# Step 3: what is left of each document.


def removed_bytes(size: int, found: np.ndarray) -> np.ndarray:
    """Which bytes of a text of that size its windows cover."""
    starts = (found["place"][:, None] - LEFT + np.arange(WINDOWS))[(found["windows"][:, None] >> np.arange(WINDOWS, dtype=np.uint32)) & 1 == 1]
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + MATCH, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for key, text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            body = _body(text)
            spans: list[list[int]] = []
            kept = body
            if found:
                gone = removed_bytes(len(body), np.frombuffer(found, FOUND))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = edges.reshape(-1, 2).tolist()
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            rows.append((key, len(body), len(body) - len(kept), spans, kept))
            held += len(kept)
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def bucketed(docs: DataFrame) -> DataFrame:
    """row, doc_id, text in buckets of `row`, as many as a shuffle has partitions; joins by row move only the other side."""
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_documents_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    writer = rows.repartition(count, "row").write.bucketBy(count, "row").option("compression", "zstd")
    writer.option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _answered(sent: DataFrame, answer, kind: np.dtype, label: str) -> DataFrame:
    """(row, found): what the shares answer, one row for each document that has any."""
    found = sent.groupBy("share").applyInPandas(answer, FOUND_BY_BUCKET)
    return staged(found.groupBy("bucket").applyInPandas(_documents_of(kind), "row long, found binary"), label)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of the removed runs), kept (the remaining bytes) of every row."""
    small_batches(docs.sparkSession)
    table = bucketed(docs)
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES))
    hashes = table.select("row", "text").mapInArrow(_send_hashes(shares), SENT)
    flags = _answered(hashes, _shared_hashes(shares), np.dtype(np.uint32), "shared-anchors")
    flagged = table.join(flags.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "text", "found")
    records = flagged.mapInArrow(_send_records(shares), SENT)
    windows = _answered(records, _repeated_windows(shares), FOUND, "repeated-windows")
    final = table.join(windows.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "text", "found")
    return final.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
