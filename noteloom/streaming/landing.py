"""Requests that land as JSON files, ingested batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.requests import validate
from ..operators.staging import stored
from ..operators.store import Store
from ..schemas import CONTENT_NOTE, RAW_REQUEST, TOPIC_NOTE

TOPIC_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TOPIC_NOTE)
CONTENT_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'upload_date' else 'string'}" for f in CONTENT_NOTE)


def in_order(requests: DataFrame) -> DataFrame:
    """Requests with seq, in the order of what they say."""
    ordered = requests.select(*RAW_REQUEST.names).orderBy("upload_date", "link", "source", "read_priority", "already_read")
    return stored(ordered.withColumn("seq", F.monotonically_increasing_id()), "requests")


def ingest_kept_into(store: Store, ingest: Callable[[Store, DataFrame, str, int], bool], source: str = "landing") -> Callable[[DataFrame, int], None]:
    """A handler for watch() as ingest_into(), for a store by parts: ingest(store, requests, source, batch) commits the batch, as ingest_kept does."""

    def handle(requests: DataFrame, batch: int) -> None:
        if not store.seen(source, batch):
            ingest(store, in_order(requests), source, batch)

    return handle


def ingest_into(store: Store, ingest: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]], source: str = "landing") -> Callable[[DataFrame, int], None]:
    """A handler for watch(): each batch's topics, contents and failures become one version of the store, once, however often the batch comes.

    ingest(requests, topic notes, content notes) gives all topic notes, all content notes and the batch's failures (seq, link, reason), as ingest_batch does. A
    batch's requests are numbered in the order of what they say, as files have none.
    """

    def handle(requests: DataFrame, batch: int) -> None:
        if store.seen(source, batch):
            return
        numbered = in_order(requests)
        topics, contents = store.read("topics", TOPIC_ROWS), store.read("contents", CONTENT_ROWS)
        topics, contents, failed = ingest(numbered, topics, contents)
        failures = store.read("failures", "batch long, seq long, link string, reason string")
        failed = failed.select(F.lit(batch).cast("long").alias("batch"), F.col("seq").cast("long").alias("seq"), "link", "reason")
        store.commit({"topics": topics, "contents": contents, "failures": failures.unionByName(failed)}, source, batch)

    return handle


def watch(spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool = True, files_a_batch: int = 1000, validated: bool = True) -> StreamingQuery:
    """handle(requests, batch id) for each batch: raw requests, or validated ones if so asked. A batch may come again after a failure, under the same id: ingest_into() tells."""
    stream = spark.readStream.schema(RAW_REQUEST).option("maxFilesPerTrigger", files_a_batch).json(landing)
    writer = (validate(stream) if validated else stream).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
