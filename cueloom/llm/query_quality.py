"""op1: base rules and likelihood ratio of every document; labels of quality 1 are the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm.quality import score_quality
from cueloom.llm.registry import documents, query


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(documents(spark, sf_dir), labels.filter("quality = 1"))
