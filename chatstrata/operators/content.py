"""The content of log roots, or of snapshots of them, as a set of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from chatstrata import constants as C
from chatstrata.schemas import FILES
from chatstrata.session import read_named_partitions

ROOT = ("root_id",)
SNAPSHOT = ("root_id", "snapshot_id")
# Names the write that a row of a store belongs to.
ATTEMPT = "attempt_id"
STORED = f"snapshot_id string, {ATTEMPT} string"


@dataclass(frozen=True)
class Content:
    """Every table has ``root_id``; those of a snapshot also have ``snapshot_id``.

    files   inventory of all files: id, rel_path, size_bytes, mtime
    lines   history and index files: rel_path, line_no, line
    states  one row per root (and snapshot) that has a state database
    tables  the state tables by name
    bodies  lines of the session logs: rel_path, line_no, line
    attachments  manifest of attachments that were copied
    """

    files: DataFrame
    lines: DataFrame
    states: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    bodies: DataFrame | None = None
    attachments: DataFrame | None = None

    def with_(self, **changes) -> Content:
        return replace(self, **changes)

    def named_tables(self) -> dict[str, DataFrame]:
        named = {"files": self.files, "lines": self.lines, "states": self.states}
        named |= {f"tables/{name}": table for name, table in self.tables.items()}
        if self.bodies is not None:
            named["bodies"] = self.bodies
        if self.attachments is not None:
            named["attachments"] = self.attachments
        return named

    def map_tables(self, change: Callable[[DataFrame], DataFrame]) -> Content:
        return Content(
            files=change(self.files),
            lines=change(self.lines),
            states=change(self.states),
            tables={name: change(table) for name, table in self.tables.items()},
            bodies=None if self.bodies is None else change(self.bodies),
            attachments=None if self.attachments is None else change(self.attachments),
        )

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Content:
        def found(name: str) -> DataFrame | None:
            try:
                return read_named_partitions(spark, f"{base}/{name}", "snapshot_id")
            except AnalysisException as error:
                # A table without any row has no file.
                if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                    raise
                return None

        def needed(name: str, schema: str) -> DataFrame:
            table = found(name)
            return spark.createDataFrame([], f"{schema}, {STORED}") if table is None else table

        names = [*C.STATE_TABLE_KEYS, *C.ACCOUNT_TABLES, *C.APP_TABLE_KEYS]
        tables = {name: found(f"tables/{name}") for name in names}
        return cls(
            files=needed("files", FILES),
            lines=needed("lines", "root_id bigint, rel_path string, line_no bigint, line string"),
            states=needed("states", "root_id bigint"),
            tables={name: table for name, table in tables.items() if table is not None},
            bodies=found("bodies"),
            attachments=found("attachments"),
        )
