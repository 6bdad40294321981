"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept: its result is written as Parquet in the folder that driver and
executors share and read again. Documents keep their columns until the last stage; n_chars follows the text.
Documents without an id count as those with the largest. Null, empty and wordless texts fail the quality rules. Of
rows equal in id and text one stays, as of all near-duplicates; of equal rows it is all the same which. Texts are worked
on whole, however long. Further columns, whatever their names, come through as they are. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteloom.llm import neardup, packing, quality, secrets, suffixes
from noteloom.llm.common import materialize, numbered

#: Strings of so many bytes that occur twice are taken out; op1_suffix_dedup keeps its contract's 400.
PASSAGE_BYTES = suffixes.PASSAGE


def _counted(documents: DataFrame) -> DataFrame:
    """n_chars, where there is one, as long as the text now is."""
    return documents.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id; of rows equal in id and text one.

    An id that several documents have links none of them: each stays unless its own text is a near-duplicate of a kept one.
    """
    # a document without an id gets one from its text, above all others
    rows, at = numbered(docs)
    own = F.coalesce(F.col(at["doc_id"]).cast("long"), F.shiftrightunsigned(F.xxhash64(at["text"]), 2).bitwiseOR(F.lit(1 << 62)))
    known = rows.withColumns({"id": own, "text_hash": F.xxhash64(at["text"])})
    kept = neardup.representatives(known.select(F.col("id").alias("doc_id"), F.col(at["text"]).alias("text"))).select(F.col("doc_id").alias("id"), "text_hash")
    same = Window.partitionBy("id", "text_hash").orderBy(at["text"])
    return neardup.meet(known, kept, ["id", "text_hash"], "left_semi").withColumn("n", F.row_number().over(same)).where("n = 1").select(*at.values()).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of PASSAGE_BYTES; those of which nothing is left go."""
    return _counted(suffixes.remove_repeats(docs, PASSAGE_BYTES)).where("text <> ''")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _counted(secrets.redact_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sketches, suffix sorting and tokens are not for SQL: tests/llm holds it against a brute-force version.
ORACLE_SQL = None
