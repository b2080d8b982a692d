"""op5: every document's ids in flat files, and what the files hold."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.registry import documents, query
from cueloom.llm.token_files import read_tokens, write_tokens
from cueloom.shared import fresh_path


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
