"""Which texts contain one of many ids, anywhere: also inside longer words, with blanks or other letters.

"The text contains the id" has no equality to join on. Ids of letters, digits, '_' and '-' have few shapes (where letters
and digits, '_' and '-' stand), mostly one: a text is cut into the runs of these shapes, overlapping ones too, and a run
that equals an id is a mention. Other ids, and these if they have many shapes, meet the texts in grams: each id stands
under the one of its grams that the fewest ids share, and a text under all its grams. What meets is verified
on the whole text. Ids of the first kind lie within one token of a text; for them only tokens longer
than the shortest such id are cut into grams, and equal tokens are found by themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.functions.text import bound
from chatstrata.operators.content import ROOT

GRAM = 8
PLAIN, OTHER = r"^[0-9A-Za-z_-]+\z", "[^0-9A-Za-z_-]+"
# The most shapes that texts are searched for.
SHAPES = 16


def _grams(text: Column, sizes: Sequence[Column | int]) -> Column:
    """The distinct runs of so many characters."""

    def of_characters(characters: Column) -> Column:
        def of_size(size: Column) -> Column:
            last = F.size(characters) - size + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda start: F.array_join(F.slice(characters, start, size), ""))

        runs = [of_size(size if isinstance(size, Column) else F.lit(size)) for size in sizes]
        return F.array_distinct(runs[0] if len(runs) == 1 else F.concat(*runs))

    return bound(F.split(text, ""), of_characters)


def _rarest_grams(ids: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Each id with the one of its grams that the fewest ids have."""
    grams = ids.select(*scope, "id", F.explode(_grams(F.col("id"), [F.least(F.length("id"), F.lit(GRAM))])).alias("gram"))
    shared = grams.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    best = grams.join(shared, [*scope, "gram"]).groupBy(*scope, "id").agg(F.min(F.struct("n", "gram")).alias("best"))
    return best.select(*scope, "id", F.col("best.gram").alias("gram"))


def _meeting(units: DataFrame, ids: DataFrame, sizes: list[int], row: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Rows and the ids whose gram is in one of their units."""
    grams = units.select(*row, F.explode(_grams(F.col("unit"), sizes)).alias("gram"))
    return grams.join(_rarest_grams(ids, scope), [*scope, "gram"]).select(*row, "id")


def _shape(id: Column) -> Column:
    return F.regexp_replace(id, "[0-9A-Za-z]", "x")


def _runs(text: Column, shapes: Sequence[str]) -> Column:
    """The distinct runs of one of the shapes, at any place."""

    def pattern(shape: str) -> str:
        parts = [(sign, len(list(same))) for sign, same in itertools.groupby(shape)]
        return "".join(f"{'[0-9A-Za-z]' if sign == 'x' else sign}{{{n}}}" for sign, n in parts)

    # A lookahead takes no text, so the next run may begin inside this one.
    runs = [F.regexp_extract_all(text, F.lit(f"(?=({pattern(shape)}))"), 1) for shape in shapes]
    return F.array_distinct(runs[0] if len(runs) == 1 else F.concat(*runs))


def containing(texts: DataFrame, ids: DataFrame, row: Sequence[str], scope: Sequence[str] = ROOT) -> DataFrame:
    """The keys `row` of the texts (row, text) that contain one of the ids (scope, id), each once.

    `row` includes the scope. Null texts and null or empty ids match nothing.
    """
    row, scope = list(row), list(scope)
    texts = texts.select(*row, "text").filter(F.col("text").isNotNull())
    wanted = ids.select(*scope, "id").filter(F.col("id") != "").distinct().withColumn("plain", F.col("id").rlike(PLAIN))
    shape = F.when(F.col("plain"), _shape(F.col("id"))).alias("shape")
    # one row more than is used says that there are too many
    shapes = [r["shape"] for r in wanted.select(shape).distinct().limit(SHAPES + 2).collect()]
    plain = sorted(shape for shape in shapes if shape is not None)
    if not shapes:
        return texts.select(*row).limit(0)
    found = []
    if len(plain) <= SHAPES:
        if plain:
            runs = texts.select(*row, F.explode(_runs(F.col("text"), plain)).alias("id"))
            found.append(runs.join(wanted.filter("plain").drop("plain"), [*scope, "id"], "left_semi").select(*row))
        if len(plain) < len(shapes):
            found.append(_by_grams(texts, wanted.filter("not plain"), row, scope))
    else:
        found.append(_by_grams(texts, wanted, row, scope))
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()


def _by_grams(texts: DataFrame, wanted: DataFrame, row: list[str], scope: list[str]) -> DataFrame:
    """What `containing` gives, rows not distinct, for ids (scope, id, plain) of any shapes."""
    size = F.least(F.length("id"), F.lit(GRAM)).alias("size")
    # at most 2 x GRAM rows
    kinds = wanted.groupBy("plain", size).agg(F.min(F.length("id")).alias("shortest")).collect()
    plain = [kind for kind in kinds if kind["plain"]]
    other = [kind for kind in kinds if not kind["plain"]]
    met, found = [], []
    if plain:
        shortest = min(kind["shortest"] for kind in plain)
        tokens = F.filter(F.array_distinct(F.split("text", OTHER)), lambda token: F.length(token) >= shortest)
        tokens = texts.select(*row, F.explode(tokens).alias("unit"))
        own = wanted.filter("plain").drop("plain")
        found.append(tokens.withColumnRenamed("unit", "id").join(own, [*scope, "id"], "left_semi").select(*row))
        longer = tokens.filter(F.length("unit") > shortest)
        met.append(_meeting(longer, own, sorted(kind["size"] for kind in plain), row, scope))
    if other:
        own = wanted.filter("not plain").drop("plain")
        met.append(_meeting(texts.withColumnRenamed("text", "unit"), own, sorted(kind["size"] for kind in other), row, scope))
    candidates = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    verified = texts.join(candidates.distinct(), row).filter(F.contains("text", "id")).select(*row)
    return verified.unionByName(found[0]) if found else verified
