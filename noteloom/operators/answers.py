"""Answers of models, kept by what was asked, so that nothing is asked twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "key string, model string, step string, answer string"


@dataclass(frozen=True)
class Answers:
    """A table of answers in a folder: key (hash of what was asked), model, step, answer (JSON). Rows are only ever added; of equal keys any one counts."""

    path: str
    model: str = "stub"

    def read(self, spark: SparkSession) -> DataFrame:
        try:
            found = spark.read.schema(ANSWER).parquet(self.path)
            found.limit(0).count()
        except AnalysisException:
            return spark.createDataFrame([], ANSWER)
        return found.where(F.col("model") == self.model)

    def known(self, spark: SparkSession, *steps: str) -> DataFrame:
        """key, known: a map from step to answer."""
        rows = self.read(spark).where(F.col("step").isin(*steps)).groupBy("key", "step").agg(F.min("answer").alias("answer"))
        return rows.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", "answer"))).alias("known"))

    def add(self, rows: DataFrame) -> None:
        """rows (key, step, answer)."""
        rows.select("key", F.lit(self.model).alias("model"), "step", "answer").write.mode("append").parquet(self.path)


def key_of(*columns: str):
    """Hash of columns, nulls told from texts."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
