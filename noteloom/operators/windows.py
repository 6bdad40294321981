"""Prefix cut by a running sum, forward fill, first and last writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.columns import word_count
from .staging import stored


def prefix_cut(pages: DataFrame, key: str, order: str, text: str, limit: float) -> DataFrame:
    """One row a key: content, its first pages with at most limit words in all ('' if the first has more), n_pages, n_words."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = pages.select(key, order, text, word_count(F.col(text)).alias("_w")).withColumn("_sum", F.sum("_w").over(running))
    fits = F.col("_sum") <= limit
    kept = F.collect_list(F.when(fits, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return counted.groupBy(key).agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["t"]), "").alias("content"), F.count(F.when(fits, 1)).alias("n_pages"), F.coalesce(F.sum(F.when(fits, F.col("_w"))), F.lit(0)).alias("n_words"))


def prefix_cut_array(pages: Column, limit: float) -> Column:
    """As prefix_cut, for an array of pages: struct(content, n_pages, n_words); nothing is shuffled."""
    start = F.struct(F.lit("").alias("content"), F.lit(0).cast("long").alias("n_pages"), F.lit(0).cast("long").alias("n_words"), F.lit(True).alias("open"))

    def step(a: Column, page: Column) -> Column:
        words = a["n_words"] + word_count(page)
        fits = a["open"] & (words <= limit)
        return F.when(fits, F.struct(F.concat(a["content"], page).alias("content"), (a["n_pages"] + 1).alias("n_pages"), words.cast("long").alias("n_words"), F.lit(True).alias("open"))).otherwise(
            F.struct(a["content"].alias("content"), a["n_pages"].alias("n_pages"), a["n_words"].alias("n_words"), F.lit(False).alias("open"))
        )

    return F.aggregate(pages, start, step)


def forward_fill(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, empty: Column | None = None) -> DataFrame:
    """Empty values (null, or where the condition holds) take the last one before them, of the same key if by names one.

    Without a key the rows are dealt to ranges of their order and written; each range is filled in a task of its own, and begins with the last value
    of the ranges before it. Of those there is one for each range: so many rows pass through the driver. Rows equal in their order are in any order among each other.
    """
    gap = F.col(value).isNull() if empty is None else empty
    if not by:
        return _filled_by_ranges(df, value, order, gap)
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(F.when(~gap, F.col(value)), ignorenulls=True).over(over))


def _filled_by_ranges(df: DataFrame, value: str, order: list[str], gap: Column) -> DataFrame:
    marked = df.withColumn("_known", F.when(~F.coalesce(gap, F.lit(True)), F.struct(F.col(value).alias("v"))))
    ranges = stored(marked.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = ranges.where("_known is not null").groupBy("_range").agg(F.max_by("_known", F.struct(*order)).alias("_last"))
    held, carried = sorted(ends.collect(), key=lambda r: r["_range"]), []
    for r in range(max((e["_range"] for e in held), default=-1) + 2):
        before = [e["_last"] for e in held if e["_range"] < r]
        carried.append((r, before[-1] if before else None))
    last = max((r for r, _ in carried), default=0)
    spark = df.sparkSession
    starts = spark.createDataFrame(carried, StructType([StructField("_range", IntegerType()), StructField("_before", ends.schema["_last"].dataType)]))
    over = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # ranges behind the last known value begin with it
    met = ranges.withColumn("_at", F.least(F.col("_range"), F.lit(last))).join(F.broadcast(starts.withColumnRenamed("_range", "_at")), "_at", "left")
    filled = F.coalesce(F.last("_known", ignorenulls=True).over(over), F.col("_before"))["v"]
    return met.withColumn(value, filled).select(*df.columns)


def first_writes(df: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Insert if absent: of each key the first row, unless the key exists. Partial aggregation, so a hot key is no burden."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in {*order, *key}])).alias("_r")).select(*key, "_r.*").select(df.columns)
    return first if existing is None else first.join(existing.select(*key).distinct(), key, "left_anti")


def last_writes(df: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Overwrite: of each key the last row; existing rows of other keys stay."""
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in {*order, *key}])).alias("_r")).select(*key, "_r.*").select(df.columns)
    return last if existing is None else existing.join(last.select(*key), key, "left_anti").unionByName(last)


def known_only(df: DataFrame, key: str, allowed: DataFrame, name: str | None = None) -> DataFrame:
    """Rows whose key is in a table of allowed values: an enumeration too long for a list of literals."""
    return df.join(allowed.select(F.col(name or key).alias(key)), key, "left_semi")
