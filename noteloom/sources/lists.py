"""One long JSON list, read by ranges of its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.requests import from_offset
from ..operators.staging import stored
from ..schemas import RAW_REQUEST


def _before(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """pieces with the sum of a column over all pieces of the file that come before: within the range by a window, over ranges by a second one of a row each."""
    earlier = Window.unboundedPreceding, -1
    sums = pieces.groupBy("file", "range").agg(F.sum(value).alias("n"))
    whole = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(*earlier)), F.lit(0))
    ranges = stored(sums.select("file", "range", whole.alias("_ranges")), "ranges")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("file", "range").orderBy("at").rowsBetween(*earlier)), F.lit(0))
    return pieces.withColumn("_own", own).join(ranges, ["file", "range"]).withColumn(name, F.col("_own") + F.col("_ranges")).drop("_own", "_ranges")


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON list of objects, however long and with or without line breaks: file, seq (from 0), entry (the object's text).

    Spark cuts the file at `}` and deals ranges of it to tasks. Whether such a brace is part of a text follows from the number of quotes before it,
    and whether it ends an entry from the number of open braces. An unfinished last entry is left out; entries that are no objects are an error.
    """
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece")
    )
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # an escape never holds a brace
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))
    quoted = _before(read.withColumn("quotes", count(plain, '"')), "quotes", "before").withColumn("inside", F.col("before") % 2)
    outside = F.regexp_replace(F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), plain), r'"[^"]*(?:"|\z)', "")
    ends = ((F.col("inside") + F.col("quotes")) % 2 == 0).cast("int")
    nested = _before(quoted.withColumns({"closed": ends, "change": count(outside, "{") - ends}), "change", "depth")
    numbered = _before(nested.withColumn("last", ((F.col("closed") == 1) & (F.col("depth") + F.col("change") == 0)).cast("int")), "last", "seq")
    whole = numbered.groupBy("file", "seq").agg(F.array_sort(F.collect_list(F.struct("range", "at", "piece"))).alias("p"), F.max("last").alias("done")).where("done = 1")
    entry = F.concat(F.array_join(F.transform("p", lambda p: p["piece"]), "}"), F.lit("}"))
    found = whole.select("file", F.col("seq").cast("int").alias("seq"), F.regexp_replace(entry, r"\A[\s,\[﻿]+", "").alias("entry"))
    return found.select("file", "seq", F.when(F.col("entry").startswith("{"), F.col("entry")).otherwise(F.raise_error(F.concat(F.lit("an entry before this is no object: "), F.substring("entry", 1, 80)))).alias("entry"))


def read_long_requests(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """As read_requests, for a list of any length: no task holds more of it than a range and the entries that begin there."""
    if not path.endswith(".json"):
        raise ValueError("a batch is a .json file")
    row = F.from_json("entry", RAW_REQUEST, {"mode": "PERMISSIVE", "primitivesAsString": "true"})
    return from_offset(list_entries(spark, path), start).select("seq", row.alias("r")).select("seq", "r.*")
