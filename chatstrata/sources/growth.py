"""What was appended to session logs since the last refresh, read once.

A feed folder has two tables. ``lines/attempt=<id>`` holds the lines of one refresh by spans: runs of whole lines that one task
read. ``spans`` holds one row per span and is written last; it is the ledger of how far each file was read:

- a file is cut into chunks of bytes, so a long file is read by many tasks; a line belongs to the chunk it begins in;
- an unterminated last line waits for the refresh that finds its end;
- the last bytes before the point reached are kept. If they differ, or the file is shorter or gone, its next *generation*
  begins at byte 0, and readers take the rows of the last generation only. A rewrite that leaves size and time of change, or
  those last bytes, as they were is not seen;
- spans of a file are committed together or not at all, and only if nothing between them is missing. Lines of an attempt that
  was not committed match no span and are left out by readers.

Only one ``refresh`` of a feed may run at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chatstrata.session import staged
from chatstrata.sources import listing, scans

FILE = ["root_id", "rel_path"]
SPANS = (
    "root_id bigint, rel_path string, generation bigint, attempt string, start_byte bigint, end_byte bigint, "
    "n_lines bigint, tail binary, size_bytes bigint, mtime timestamp"
)
# A row with n_lines closes its span; the others are its lines.
READ = (
    "root_id bigint, rel_path string, generation bigint, start_byte bigint, nth bigint, line string, n_lines bigint, "
    "end_byte bigint, tail binary, from_byte bigint, size_bytes bigint, mtime timestamp"
)
READ_SCHEMA = pa.schema(
    [
        ("root_id", pa.int64()),
        ("rel_path", pa.string()),
        ("generation", pa.int64()),
        ("start_byte", pa.int64()),
        ("nth", pa.int64()),
        # Bytes as they lie in the file; the cast to text is Spark's, as in a scan.
        ("line", pa.binary()),
        ("n_lines", pa.int64()),
        ("end_byte", pa.int64()),
        ("tail", pa.binary()),
        ("from_byte", pa.int64()),
        ("size_bytes", pa.int64()),
        ("mtime", pa.timestamp("us", "UTC")),
    ]
)
CHUNK_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
TAIL_BYTES = 256
BATCH_ROWS = 4096


def spans(spark: SparkSession, feed: str) -> DataFrame:
    """The committed spans of a feed."""
    try:
        spark.read.parquet(f"{feed}/spans")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], SPANS)
    return spark.read.schema(SPANS).parquet(f"{feed}/spans")


def _reached(spark: SparkSession, feed: str) -> DataFrame:
    """How far each file was read, by its last generation."""
    last = F.struct("generation", "end_byte", "mtime")
    point = F.max_by(F.struct("generation", "end_byte", "tail", "size_bytes", "mtime"), last).alias("was")
    return spans(spark, feed).groupBy(*FILE).agg(point)


def _tail_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the bytes before the point reached are still those that were read."""
    for batch in batches:
        kept = []
        for path, end, tail in zip(*(batch.column(name).to_pylist() for name in ("path", "end_byte", "tail"))):
            system, inner, _ = listing._opened(path)
            try:
                with system.open_input_file(inner) as source:
                    source.seek(end - len(tail))
                    kept.append(source.read(len(tail)) == tail)
            except FileNotFoundError:
                kept.append(False)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(kept, pa.bool_())], ["path", "tail_kept"])


def whole_lines(source, begin: int, first: int, stop: int, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the terminated lines that begin in [begin, stop) and end by ``limit``.

    ``first`` begins a line; any other ``begin`` may lie within one, which belongs to an earlier chunk.
    """
    skipping = begin > first
    # With the byte before, a line that begins right at ``begin`` is seen.
    here = start = begin - 1 if skipping else begin
    pieces: list[bytes] = []
    source.seek(here)
    while start < stop and here < limit and not (skipping and here >= stop):
        block = source.read(min(BLOCK_BYTES, limit - here))
        if not block:
            return
        done = 0
        while start < stop and (found := block.find(b"\n", done)) >= 0:
            end = here + found + 1
            if skipping:
                skipping = False
            else:
                yield start, end, b"".join([*pieces, block[done:found]])
            pieces.clear()
            done, start = found + 1, end
        if not skipping:
            pieces.append(block[done:])
        here += len(block)


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each chunk, and a row that closes it. A file that is gone has no rows."""
    rows: list[dict] = []
    held = 0

    def packed() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_pylist(rows, READ_SCHEMA)
        rows.clear()
        held = 0
        return batch

    for batch in batches:
        for chunk in batch.to_pylist():
            of_file = {name: chunk[name] for name in ("root_id", "rel_path", "generation")}
            system, inner, _ = listing._opened(chunk["path"])
            try:
                source = system.open_input_file(inner)
            except FileNotFoundError:
                continue
            with source:
                span_start = end = None
                nth = 0
                begin, first, size = chunk["begin"], chunk["from_byte"], chunk["size_bytes"]
                for start, end, line in whole_lines(source, begin, first, chunk["stop"], size):
                    span_start = start if span_start is None else span_start
                    line = line[:-1] if line.endswith(b"\r") else line
                    if line:
                        rows.append(of_file | {"start_byte": span_start, "nth": nth, "line": line})
                        nth += 1
                        held += len(line)
                    if held >= listing.BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield packed()
                if end is None:
                    continue
                source.seek(max(0, end - TAIL_BYTES))
                closing = {"n_lines": nth, "end_byte": end, "tail": source.read(min(end, TAIL_BYTES)), "from_byte": first}
                rows.append(of_file | closing | {"start_byte": span_start, "size_bytes": size, "mtime": chunk["mtime"]})
    if rows:
        yield packed()


def _changed(spark: SparkSession, base: str | list[str], feed: str, root_pattern: str) -> DataFrame:
    """Files to read on or anew, and files that are gone: (root_id, rel_path, path, generation, from_byte, size_bytes, mtime, reset)."""
    listed = scans._located(listing.list_files(spark, base), root_pattern)
    logs = listed.filter(F.col("problem").isNull() & F.col("root_id").isNotNull() & scans._session_log(F.col("rel_path")))
    both = logs.select(*FILE, "path", "size_bytes", "mtime").join(_reached(spark, feed), FILE, "full")
    same = (F.col("size_bytes") == F.col("was.size_bytes")) & (F.col("mtime") == F.col("was.mtime"))
    stays_gone = F.col("path").isNull() & F.col("was.mtime").isNull()
    touched = staged(both.filter(~F.coalesce(same, F.lit(False)) & ~stays_gone), "touched")
    # Only files read before have a tail; a file that got shorter needs no look.
    doubtful = touched.filter("was.end_byte > 0 and size_bytes >= was.end_byte").select("path", "was.end_byte", "was.tail")
    kept = listing._dealt(doubtful).mapInArrow(_tail_kept, "path string, tail_kept boolean")
    judged = touched.join(kept, "path", "left")
    reset = F.coalesce("was.end_byte", F.lit(0)) > F.when(F.coalesce("tail_kept", F.lit(False)), F.col("was.end_byte")).otherwise(0)
    gone = F.col("path").isNull()
    judged = judged.withColumn("reset", reset | gone)
    return judged.select(
        *FILE,
        "path",
        (F.coalesce("was.generation", F.lit(0)) + F.col("reset").cast("bigint")).alias("generation"),
        F.when(F.col("reset"), 0).otherwise(F.coalesce("was.end_byte", F.lit(0))).cast("bigint").alias("from_byte"),
        "size_bytes",
        "mtime",
        "reset",
    )


def refresh(
    spark: SparkSession,
    base: str | list[str],
    feed: str,
    root_pattern: str = scans.ROOT_PATTERN,
    chunk_bytes: int = CHUNK_BYTES,
) -> int:
    """Reads what the session logs below ``base`` grew by into the feed; returns the number of new spans.

    Bytes read are those appended, and the whole of files that were rewritten. A file is listed and judged, but not
    opened, if its size and time of change are as before. Logs are files, not folders of part files.
    """
    changed = staged(_changed(spark, base, feed, root_pattern), "changed")
    if changed.isEmpty():
        return 0
    attempt = f"attempt-{uuid.uuid4().hex}"
    begins = F.explode(F.sequence("from_byte", F.col("size_bytes") - 1, F.lit(chunk_bytes).cast("bigint")))
    chunks = changed.filter("path is not null and size_bytes > from_byte").withColumn("begin", begins)
    chunks = chunks.withColumn("stop", F.least(F.col("begin") + chunk_bytes, "size_bytes")).drop("reset")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    as_read = ", ".join(f"{f} binary" if f == "line" else f"{f} {t}" for f, t in (c.split() for c in READ.split(", ")))
    read = chunks.repartition(tasks, "path", "begin").mapInArrow(_read_chunks, as_read)
    path = f"{feed}/lines/attempt={attempt}"
    read.withColumn("line", F.col("line").cast("string")).write.parquet(path)
    closing = spark.read.schema(READ).parquet(path).filter("n_lines is not null")
    # Chunks of a file that went meanwhile may be missing; such a file waits for the next refresh.
    of_file = W.partitionBy(*FILE)
    covered = F.sum(F.col("end_byte") - F.col("start_byte")).over(of_file)
    new = closing.withColumn("whole", covered == F.max("end_byte").over(of_file) - F.col("from_byte")).filter("whole")
    columns = [c.split()[0] for c in SPANS.split(", ")]
    new = new.withColumn("attempt", F.lit(attempt)).select(*columns)
    # An empty span begins each generation but the first, so that readers know of it even if it has no line.
    opening = changed.filter("reset").select(
        *FILE, "generation", F.lit(attempt).alias("attempt"), F.lit(0).cast("bigint").alias("start_byte"),
        F.lit(0).cast("bigint").alias("end_byte"), F.lit(0).cast("bigint").alias("n_lines"), F.lit(b"").alias("tail"),
        "size_bytes", "mtime",
    )
    # The spans of a file are in one part file, so they appear together.
    new = staged(opening.select(*columns).unionByName(new).repartition(tasks, *FILE), "spans")
    count = new.count()
    if count:
        new.repartition(tasks, *FILE).write.mode("append").parquet(f"{feed}/spans")
    return count
