"""JSON values of unknown shape, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatstrata import constants as C
from chatstrata.functions.nested import nested_names, nested_text
from chatstrata.functions.paths import is_local_attachment, normalize_path
from chatstrata.functions.text import bound, is_blank

# Levels that are unrolled in the JVM; what is nested deeper goes to ``nested``.
# Each level handles an array or an object; a usual message body needs three.
TEXT_DEPTH = 8
ATTACHMENT_DEPTH = 6
ATTACHMENT_LISTS = ["images", "local_images", "text_elements"]


def parse_line(line: Column) -> Column:
    """The line as VARIANT; null when it is not JSON."""
    return F.try_parse_json(line)


def field(value: Column, path: str) -> Column:
    """Text of a scalar at a path; null when missing."""
    return F.try_variant_get(value, f"$.{path}", "string")


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _items(value: Column) -> Column:
    """Elements of an array; null for every other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column, keys: list[str]) -> Column:
    """Struct of the given keys of an object; null for every other value."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{key}:variant' for key in keys)}>")


def as_string(value: Column) -> Column:
    """The value when it is a JSON string, else null."""
    # The type of a scalar is cheap to ask for; that of an array or object means walking it.
    scalar = _items(value).isNull() & _members(value, ["type"]).isNull()
    return F.when(
        scalar, F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    )


def _text_children(value: Column) -> Column:
    """Parts of an array, or what an object has under its text keys; empty for scalars."""
    members = _members(value, C.TEXT_KEYS)
    keyed = F.array(*[members[key] for key in C.TEXT_KEYS])
    # Without the nulls, or each of them would be searched level by level.
    return F.array_compact(F.coalesce(_items(value), keyed))


def extract_text(value: Column, depth: int = TEXT_DEPTH) -> Column:
    """Text of a message body: strings as they are, array parts joined by newline
    without the blank ones, for objects the first non-blank text key, else ''.

    The recursion is unrolled. A level is named once in the next one, so the
    expression grows linearly with the depth.
    """
    return bound(value, lambda body: _text(body, depth))


def _text(value: Column, depth: int) -> Column:
    string = as_string(value)
    if depth == 0:
        return F.coalesce(string, F.lit(""))
    texts = F.filter(
        F.transform(_text_children(value), lambda child: _text(child, depth - 1)),
        lambda text: ~is_blank(text),
    )
    # An array takes all its parts, an object only the first one found.
    taken = F.slice(texts, F.lit(1), F.when(_items(value).isNotNull(), F.lit(2**31 - 1)).otherwise(1))
    return F.coalesce(string, F.array_join(taken, "\n"))


def whole_text(value: Column) -> Column:
    """Text of a message body of any depth; for a select, as it holds an Arrow function."""
    deep = F.when(exceeds_depth(value), F.to_json(value))
    return F.coalesce(nested_text(deep), extract_text(value))


def deeper_than(value: Column, depth: int) -> Column:
    """True when arrays or objects are nested in one another more than ``depth`` times."""
    return F.coalesce(bound(value, lambda body: _deeper(body, depth)), F.lit(False))


def _deeper(value: Column, depth: int) -> Column:
    children = F.coalesce(_items(value), F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))
    if depth == 0:
        return children.isNotNull()
    # Without the nulls, or each of them would be searched level by level.
    return F.coalesce(F.exists(F.array_compact(children), lambda child: _deeper(child, depth - 1)), F.lit(False))


def whole_attachment_paths(payload: Column) -> Column:
    """Distinct local attachment paths in a payload of any depth; for a select, as it holds an Arrow function."""
    names = nested_names(F.when(deeper_than(payload, ATTACHMENT_DEPTH), F.to_json(payload)))
    return F.when(names["plain"].isNull(), content_attachment_paths(payload)).otherwise(
        F.array_distinct(F.transform(_usable(names["plain"], names["urls"]), normalize_path))
    )


def _usable(plain: Column, urls: Column) -> Column:
    """The local attachments among path strings, and the paths of file urls."""
    return F.concat(F.filter(plain, is_local_attachment), F.array_compact(F.transform(urls, _file_url_path)))


def exceeds_depth(value: Column, depth: int = TEXT_DEPTH) -> Column:
    """True when arrays or objects are still left below ``depth`` levels of a body."""
    if depth == 0:
        return _items(value).isNotNull() | _members(value, ["type"]).isNotNull()
    return F.coalesce(
        F.exists(_text_children(value), lambda child: exceeds_depth(child, depth - 1)), F.lit(False)
    )


def content_attachment_paths(payload: Column, depth: int = ATTACHMENT_DEPTH) -> Column:
    """Distinct local attachment paths named by the payload of one log line."""
    listed = [_items(part(payload, key)) for key in ATTACHMENT_LISTS]
    typed = _attachment_objects(_items(part(payload, "content")), depth)
    none = F.array().cast("array<variant>")
    values = F.flatten(F.array(*[F.coalesce(found, none) for found in (*listed, typed)]))
    return F.array_distinct(F.flatten(F.transform(values, lambda value: _local_paths(value, depth))))


def _attachment_objects(items: Column, depth: int) -> Column:
    """Attachment-like objects among the items and in arrays nested in them."""
    if depth == 0:
        return F.filter(items, _is_attachment)

    def own_or_nested(item: Column) -> Column:
        inner = _items(item)
        return F.when(inner.isNotNull(), _attachment_objects(inner, depth - 1)).otherwise(
            F.filter(F.array(item), _is_attachment)
        )

    return F.flatten(F.transform(items, own_or_nested))


def _local_paths(value: Column, depth: int) -> Column:
    """Paths in a string, an array, or an object with its path and url keys."""
    keyed = _members(value, [*C.ATTACHMENT_PATH_KEYS, *C.ATTACHMENT_URL_KEYS])

    def strings(keys: list[str]) -> Column:
        return F.transform(F.array_compact(F.array(*[keyed[key] for key in keys])), as_string)

    plain = F.concat(F.array(as_string(value)), strings(C.ATTACHMENT_PATH_KEYS))
    own = F.transform(_usable(plain, strings(C.ATTACHMENT_URL_KEYS)), normalize_path)
    if depth == 0:
        return own
    members = F.when(_is_attachment(value), F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))
    children = F.coalesce(_items(value), members, F.array().cast("array<variant>"))
    nested = F.transform(children, lambda child: _local_paths(child, depth - 1))
    return F.concat(own, F.flatten(nested))


def _is_attachment(value: Column) -> Column:
    return F.coalesce(F.lower(as_string(part(value, "type"))).isin(C.ATTACHMENT_TYPES), F.lit(False))


def _file_url_path(url: Column) -> Column:
    """Decoded path of a file:// url, without host, query and fragment."""
    path = F.regexp_extract(url, r"(?s)^file://[^/?#]*(/[^?#]*)", 1)
    return F.when(path != "", F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def ids_of(value: Column) -> Column:
    """Session ids under the id keys of a parsed line."""
    return F.array_compact(F.array(*[field(value, key) for key in C.LINE_ID_KEYS]))


def line_ids(line: Column) -> Column:
    """Session ids under the id keys of a JSON line."""
    return bound(parse_line(line), ids_of)


def line_identity(line: Column, key: str | None) -> Column:
    """What makes a line unique: the value of a JSON key if present, else the line.

    The two kinds are told apart by a leading letter.
    """
    whole = F.concat(F.lit("l:"), line)
    if key is None:
        return whole
    return F.coalesce(F.concat(F.lit(f"k:{key}:"), field(parse_line(line), key)), whole)
