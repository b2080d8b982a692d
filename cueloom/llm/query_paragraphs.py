"""op8: passages that stand in several documents, and the spans to remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.paragraphs import repeated_passages
from cueloom.llm.registry import documents, query


@query("op8_passage_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "class_id", "first_ids", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"]).alias("n_removed"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("removed"),
    )
