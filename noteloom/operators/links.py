"""A maintained index of links: which notes link to a topic, and in which part of the notes' table they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import followed, rewrite_links
from .staging import stored

KEY = ("content_type", "title")
#: Folders of a notes' table: what a rewrite reads is whole folders.
PARTS = 256


def part_of(parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")


def write_parts(notes: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """notes (content_type, title, body, ...) written by their part, and read back with it."""
    notes.withColumn("part", part_of(parts)).repartition("part").write.partitionBy("part").parquet(path)
    return notes.sparkSession.read.schema(notes.withColumn("part", F.lit(0)).schema).parquet(path)


def moved_targets(ways: DataFrame) -> DataFrame:
    """target: what links say that merges (ways, as followed() gives them) move."""
    return ways.select(F.expr("substring(old, 3, length(old) - 4)").alias("target")).distinct()


def link_index(notes: DataFrame) -> DataFrame:
    """target, part, content_type, title: each [[target]] of each note (with its part) once."""
    targets = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)\]\]"), F.lit(1)))
    return notes.select(F.explode(targets).alias("target"), "part", *KEY)


def with_written(index: DataFrame, written: DataFrame) -> DataFrame:
    """The index after notes were written anew or for the first time: only their bodies are read. A note without links leaves it."""
    return index.join(written.select(*KEY).distinct(), list(KEY), "left_anti").select(*index.columns).unionByName(link_index(written))


def without(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after notes (content_type, title) were deleted."""
    return index.join(deleted.select(*KEY).distinct(), list(KEY), "left_anti").select(*index.columns)


def linked_notes(index: DataFrame, ways: DataFrame) -> DataFrame:
    """part, content_type, title of the notes with a link that merges (ways, as followed() gives them) move."""
    return index.join(moved_targets(ways), "target", "left_semi").select("part", *KEY).distinct()


def rewrite_linked(notes: DataFrame, index: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes that merges change, with their new bodies, and the index after that; notes: a table by parts, as write_parts() gives it.

    Instead of all bodies, the index is searched for the merged topics, and only parts with notes that link to them are read. Their
    numbers pass through the driver: at most as many as there are parts. Same bodies as rewrite_links.
    """
    ways = stored(followed(merges), "ways")
    found = stored(linked_notes(index, ways), "linked")
    parts = sorted(r.part for r in found.select("part").distinct().collect())
    read = notes.where(F.col("part").isin(parts)).join(found, ["part", *KEY], "left_semi").select(*notes.columns)
    changed = stored(rewrite_links(read, merges, ways), "rewritten")
    return changed, with_written(index, changed)
