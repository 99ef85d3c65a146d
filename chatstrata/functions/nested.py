"""JSON bodies that are nested deeper than the unrolled expressions reach.

The expressions of ``jsonlines`` cover the usual depths inside the JVM. What is nested
deeper is handed over as JSON text, null for every other row, and read here in Arrow
batches at any depth.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from chatstrata import constants as C

# Deeper than any JSON text that Spark parses.
FRAMES = 10_000
NAMES = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in ("plain", "urls")])
LISTS = ("images", "local_images", "text_elements")


def _text(body: object) -> str:
    if isinstance(body, str):
        return body
    if isinstance(body, list):
        return "\n".join(text for text in map(_text, body) if text.strip(C.WHITESPACE))
    if isinstance(body, dict):
        found = (_text(body[key]) for key in C.TEXT_KEYS if key in body)
        return next((text for text in found if text.strip(C.WHITESPACE)), "")
    return ""


def _is_attachment(value: object) -> bool:
    kind = value.get("type") if isinstance(value, dict) else None
    return isinstance(kind, str) and kind.lower() in C.ATTACHMENT_TYPES


def _attachment_objects(items: list) -> list:
    found = []
    for item in items:
        found += _attachment_objects(item) if isinstance(item, list) else [item] if _is_attachment(item) else []
    return found


def _named(value: object, plain: list[str], urls: list[str]) -> None:
    """The strings that may be paths, and those that may be urls of files."""
    if isinstance(value, str):
        plain.append(value)
    children = value if isinstance(value, list) else []
    if isinstance(value, dict):
        plain += [value[key] for key in C.ATTACHMENT_PATH_KEYS if isinstance(value.get(key), str)]
        urls += [value[key] for key in C.ATTACHMENT_URL_KEYS if isinstance(value.get(key), str)]
        children = value.values() if _is_attachment(value) else []
    for child in children:
        _named(child, plain, urls)


def _of_payload(payload: object) -> dict[str, list[str]]:
    plain: list[str] = []
    urls: list[str] = []
    if isinstance(payload, dict):
        values = [item for key in LISTS if isinstance(payload.get(key), list) for item in payload[key]]
        content = payload.get("content")
        values += _attachment_objects(content) if isinstance(content, list) else []
        for value in values:
            _named(value, plain, urls)
    return {"plain": plain, "urls": urls}


@pandas_udf(T.StringType())
def nested_text(bodies: pd.Series) -> pd.Series:
    sys.setrecursionlimit(FRAMES)
    return bodies.map(lambda body: _text(json.loads(body)), na_action="ignore")


@pandas_udf(NAMES)
def nested_names(payloads: pd.Series) -> pd.DataFrame:
    sys.setrecursionlimit(FRAMES)
    found = [None if payload is None else _of_payload(json.loads(payload)) for payload in payloads]
    return pd.DataFrame({key: [None if row is None else row[key] for row in found] for key in ("plain", "urls")})
