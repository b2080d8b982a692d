"""Evidence pools in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def evidence_pool(observations: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Usable observations of every pool plus one first-pass transcript per window.

    Nothing is merged by text: two observers with the same words remain two rows.
    """
    usable = observations.filter("status = 'ok' AND text <> ''").withColumn("origin", F.lit("pool"))
    first = transcripts.groupBy(F.expr("doc_id div 20").alias("owner_id")).agg(F.min(F.struct("doc_id", "lang", "text")).alias("d"))
    raw = first.select(
        F.col("d.lang").alias("episode_id"), "owner_id", F.lit("raw").alias("observer"),
        F.lit(-1).cast("bigint").alias("pool_ord"), F.col("d.doc_id").alias("pos"), "d.text",
        F.lit("first_pass").alias("origin"),
    )
    return usable.unionByName(raw, allowMissingColumns=True)
