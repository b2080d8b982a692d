"""op13: all documents in windows of 1,024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cueloom.llm.packing import pack
from cueloom.llm.registry import documents, query


@query("op13_packed_windows")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
