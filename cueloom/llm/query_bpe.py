"""op4: every text encoded and decoded with a public word-level BPE vocabulary."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.bpe import decode, encode
from cueloom.llm.registry import documents, query


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text"), path)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
