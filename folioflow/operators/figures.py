"""Figures of many documents as relations: where they stand, which have no place, and the index of each, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: an image of the output's own assets.
IMAGE = r"!\[((?:\\.|[^\]])*)\]\((assets/[^)\r\n]+)\)"
GAP = r"\n[ \t\n\x0b\x0c\r]*\n"


def plain(c: Column, limit: int) -> Column:
    return text.Text(text.PLAIN.steps, text.PLAIN.trim, limit, True).column(c)


def nearby(before: Column, after: Column) -> Column:
    """The end of the paragraph before an image, or the start of the one after it, if they touch it."""
    last, first = F.element_at(F.split(before, GAP), -1), F.element_at(F.split(after, GAP), 1)
    said = plain(F.when(last != "", last).otherwise(first), 180)
    return F.when(said == "", "No nearby text.").otherwise(said)


def caption(alt: Column, label: Column) -> Column:
    said, other = plain(alt, 300), plain(label, 300)
    return F.when(said != "", said).when(other != "", other).otherwise("Image")


def occurrences(units: DataFrame, keys: list[str], markdown: str) -> DataFrame:
    """``keys``, ``nth`` (of the images of a unit), ``alt``, ``output_path``, ``near``: one row for each image of a unit."""
    parts = F.split(F.col(markdown), IMAGE)  # the text around the images; Java leaves groups out
    found = units.select(*keys, parts.alias("parts"), F.posexplode(F.arrays_zip(F.regexp_extract_all(markdown, F.lit(IMAGE), 1).alias("alt"), F.regexp_extract_all(markdown, F.lit(IMAGE), 2).alias("output_path"))).alias("nth", "image"))
    # a paragraph before an image may begin behind an earlier image: then it is not what touches this one
    before, after = F.element_at("parts", F.col("nth") + 1), F.element_at("parts", F.col("nth") + 2)
    return found.select(*keys, (F.col("nth") + 1).cast("long").alias("nth"), F.col("image.alt").alias("alt"), F.col("image.output_path").alias("output_path"), nearby(before, after).alias("near"))


def placed_in_canonical(found: DataFrame, units: DataFrame, doc: str, seq: str, canonical: str) -> DataFrame:
    """Occurrences in canonical units, or in all units of a document that has none."""
    any_canonical = units.groupBy(doc).agg(F.max(F.col(canonical).cast("int")).alias("some"))
    chosen = units.join(any_canonical, doc).where(F.col(canonical) | (F.col("some") == 0)).select(doc, seq)
    return found.join(chosen, [doc, seq], "left_semi")


def unplaced(assets: DataFrame, found: DataFrame, doc: str, path: str = "output_path") -> DataFrame:
    """Assets that no occurrence shows."""
    return assets.join(found.select(doc, path), [doc, path], "left_anti")


def index(assets: DataFrame, found: DataFrame, doc: str, seq: str) -> DataFrame:
    """``doc``, ``figure``, ``output_path``, ``places`` (chapter ids in order, joined), ``caption``, ``near`` (of the first place)."""
    spots = F.array_sort(F.collect_list(F.struct(seq, "nth", "alt", "near")))
    grouped = found.groupBy(doc, "output_path").agg(spots.alias("spots"))
    rows = assets.join(grouped, [doc, "output_path"], "left")
    first = F.get("spots", F.lit(0))
    places = F.array_join(F.array_distinct(F.transform("spots", lambda s: text.numbered("CHAPTER-", s[seq], 3))), "; ")
    return rows.select(doc, "figure", "output_path", F.coalesce(places, F.lit("No place in the reading order")).alias("places"), caption(F.coalesce(first["alt"], F.lit("")), F.col("label")).alias("caption"), F.coalesce(first["near"], F.lit("No nearby text.")).alias("near"))
