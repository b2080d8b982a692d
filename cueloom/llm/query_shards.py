"""op2: all documents on 16 shards whose counts differ by at most one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.registry import documents, query
from cueloom.llm.shards import assign_shards


@query("op2_bounded_ring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home",
    )
