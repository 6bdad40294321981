"""Helpers that every operator of the subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one round of numpy work, in characters.
BLOCK_CHARS = 1 << 21
#: Folders of the tables that materialize() has written in this session and that are still there.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir().

    Where neither is set, a folder of this machine, if all tasks run on it (local master: tests); else an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/noteloom-checkpoints")
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors.

    Unlike checkpoint(), this runs the plan once, not twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteloom-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, written; the tables that it wrote on the way are deleted, as only the result read them."""
    point = len(_written)
    result = make()
    spark = result.sparkSession
    out = materialize(result, label)
    for path in _written[point:-1]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    del _written[point:-1]
    free_shuffles(spark)
    return out


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns (name=type), cast; further columns, whatever their names, go."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns as c0, c1 ..., so that no name clashes with another or needs quotes, and the new name of each; toDF(*df.columns) gives the names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most about `chars` of text each (a longer text comes alone); null texts come as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()] if batch.num_rows < 2048 else None
        if texts is None:
            for at in range(0, batch.num_rows, 2047):
                yield from text_blocks(iter([batch.slice(at, 2047)]), column, chars)
            continue
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > chars:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As text_blocks, for UTF-8 bytes."""
    for batch in batches:
        raw = batch.column(column)
        raw = raw.cast(pa.binary()) if pa.types.is_string(raw.type) else raw
        for at in range(0, batch.num_rows, 2048):
            part, texts = batch.slice(at, 2048), [t or b"" for t in raw.slice(at, 2048).to_pylist()]
            begin, size = 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > limit:
                    yield part.slice(begin, i - begin), texts[begin:i]
                    begin, size = i, 0
                size += len(t)
            if begin < len(texts):
                yield part.slice(begin), texts[begin:]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
