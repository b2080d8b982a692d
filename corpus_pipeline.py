"""A corpus pipeline of five operators: toxicity, lines, near copies, contamination, token ids.

Every stage takes all documents that its predecessor kept, and all but the last return the columns
of ``documents``; ``run`` writes each stage's result to the shared folder and reads it back for the
next.  Cases of null, empty, long and repeated rows are those the operators define; a stage keeps
whatever its rule does not name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.bpe import decode, encode
from cueloom.llm.jaccard import jaccard_components, keep_one
from cueloom.llm.lines import dedup_lines
from cueloom.llm.query_toxicity import THRESHOLD, held_out
from cueloom.llm.query_winnow import judged
from cueloom.llm.toxicity import fit_toxicity, score_toxicity
from cueloom.llm.winnow import contamination
from cueloom.shared import pin

VOCABULARY = "word_bpe_49k.json"
#: Not expressible in SQL (a fitted chain, components, BPE); tests hold run() against brute force.
ORACLE_SQL = None


def _others(docs: DataFrame, *known: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in known)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), carry=_others(docs, "doc_id"))
    return scored.filter(F.col("score") < THRESHOLD).select("own.*").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text, and a document goes when all its lines
    with words were repeats."""
    made = dedup_lines(docs, carry=_others(docs, "doc_id", "text"))
    kept = made.filter("n_lines = 0 OR n_removed < n_lines").select("own.*", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return keep_one(docs, jaccard_components(docs)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=_others(docs, "doc_id"))
    return judged(found).filter(~F.col("contaminated")).select("own.*").select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256); ids are packed unsigned 32-bit integers."""
    path = public_tokenizers.path(VOCABULARY)
    ids = encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text")
    return decode(ids, path).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
