"""op6: every document scored; a third of the ids is held out of fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.registry import documents, query
from cueloom.llm.toxicity import Field, fit_toxicity, score_toxicity

THRESHOLD = 0.7


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> Field:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return fit_toxicity(documents(spark, sf_dir), labels)


@query("op6_toxic_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), fitted(spark, sf_dir))
    doc_id = F.col("own.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans",
    )
