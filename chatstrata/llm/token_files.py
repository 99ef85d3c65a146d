"""Token ids as flat binary files.

A file set has three flat little-endian files: `<name>.bin` holds the ids of its documents one
after another (unsigned 16-bit if all ids fit, else 32-bit), `<name>.idx` the 64-bit offset of each
document in ids and of the end, `<name>.doc` the 64-bit doc_ids. File sets are in the order of doc_id. A
file's base, the number of ids before it, is the prefix sum of the counts in the manifest.

Each attempt of a task writes a file set of its own name; only those that the manifest
lists count, so lost executors and speculative tasks leave no wrong data.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first and is kept as
the least 64-bit number. Rows that repeat a doc_id follow each other. An empty table gives no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstrata.llm.common import prefix_sums
from chatstrata.llm.token_ids import encoder, tokenizer_path
from chatstrata.session import scratch_path, staged

END_ID = 2
NO_ID = -(1 << 63)
MANIFEST = "part long, path string, documents long, tokens long, width int"


def file_system(uri: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents in the order of doc_id; returns the staged manifest with the `base` of each file set."""
    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(path)
        width = 2 if words.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        store, root = file_system(folder)
        name = f"{root}/ids-{uuid.uuid4().hex}"
        keys: list[int] = []
        ends = [np.zeros(1, np.int64)]
        total, out = 0, None
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{name}.bin")
            sizes = []
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                whole = np.append(ids, np.uint32(end_id)).astype(f"<u{width}")
                out.write(whole.tobytes())
                keys.append(NO_ID if key is None else key)
                sizes.append(len(whole))
            ends.append(total + np.cumsum(sizes, dtype=np.int64))
            total = int(ends[-1][-1]) if sizes else total
        if out is not None:
            out.close()
            for ending, values in (("idx", np.concatenate(ends)), ("doc", np.array(keys, np.int64))):
                with store.open_output_stream(f"{name}.{ending}") as file:
                    file.write(values.astype("<i8").tobytes())
            row = [[TaskContext.get().partitionId()], [name], [len(keys)], [total], [width]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["part", "path", "documents", "tokens", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    return prefix_sums(manifest, "part", "tokens", "base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit) from the files of a manifest."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                offsets = _numbers(store, f"{row['path']}.idx", "<i8")
                keys = _numbers(store, f"{row['path']}.doc", "<i8")
                ids = _numbers(store, f"{row['path']}.bin", f"<u{row['width']}")
                first = 0
                while first < row["documents"]:
                    # some 4 million ids at a time
                    after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 22), "right")) - 1)
                    part = [ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(first, after)]
                    columns = [
                        pa.array(keys[first:after], pa.int64(), mask=keys[first:after] == NO_ID),
                        pa.array(offsets[first:after] + row["base"], pa.int64()),
                        pa.array(part, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                    first = after

    listed = manifest.select("part", "path", "documents", "width", "base")
    files = max(1, listed.count())
    return listed.repartition(files, "part").mapInArrow(read, "doc_id long, start long, ids binary")


def _numbers(store, path: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped if it is on a mounted file system, else read."""
    from pyarrow import fs

    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents written to the shared folder and read back: doc_id, start, ids."""
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder), folder)


