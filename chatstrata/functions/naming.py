"""Names, reasons and kinds of snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatstrata import constants as C


def _given(text: Column) -> Column:
    return F.when(text != "", text)


def effective_reason(reason: Column, snapshot_id: Column) -> Column:
    """Stored reason, else the part of the id after its time stamp, else 'unknown'."""
    from_id = F.when(F.length(snapshot_id) > 16, F.substr(snapshot_id, F.lit(17)))
    return F.coalesce(_given(reason), from_id, F.lit("unknown"))


def effective_kind(kind: Column, reason: Column, snapshot_id: Column) -> Column:
    inferred = F.when(effective_reason(reason, snapshot_id) == "manual", "manual").otherwise("system")
    return F.coalesce(_given(kind), inferred)


def kind_label(kind: Column) -> Column:
    return F.when(kind == "manual", C.KIND_LABELS["manual"]).otherwise(C.KIND_LABELS["system"])


def default_snapshot_name(reason: Column, provider: Column, model: Column) -> Column:
    names = F.create_map(*[F.lit(text) for pair in C.SNAPSHOT_NAMES.items() for text in pair])
    label = F.coalesce(F.try_element_at(names, reason), F.lit(C.DEFAULT_SNAPSHOT_NAME))
    return F.concat(label, F.lit(" · "), provider, F.lit("/"), model)


def snapshot_base_id(created_at: Column, reason: Column) -> Column:
    return F.concat(F.date_format(created_at, "yyyyMMdd-HHmmss"), F.lit("-"), reason)
