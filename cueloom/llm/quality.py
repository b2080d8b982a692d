"""Quality rules with column functions only: base rules and a hashed n-gram likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over the trusted target
documents, one over the whole raw corpus.  A document's score is the mean of
``log p_target - log p_raw`` over its n-grams, so its length cancels; a document is kept when it
passes the base rules and its score reaches the threshold.  Counts are integers and the sum runs in
text order, so every document gets the same verdict on every run.

Nothing is sampled: all documents and all trusted documents are counted, with map-side aggregation
to at most ``buckets`` rows per task.  The table of log ratios has exactly ``buckets`` entries and
reaches the scoring pass as a scalar subquery.

Defined cases: null and empty texts have no words, fail the base rules and have a null score;
repeated rows each get a row and each count; labels may be missing, null or repeated (a document is
trusted if any of its labels says so); with no trusted document every ratio is the smoothed prior.
Null ids are never trusted.  Other columns are ignored.  Repeated windows are found by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.12
GAP = r"[\x20\x09-\x0D]+"


def fixed(df: DataFrame) -> DataFrame:
    """The same columns, computed here: conditions put on them later are not moved below, where they would be
    computed again for every element of the arrays they rest on."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def words(text: Column) -> Column:
    """Maximal runs without space and ASCII white space; none for null."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def _grams(buckets: int) -> Column:
    """Bucket numbers of the unigrams and bigrams of column ``words``."""
    size = F.lit(buckets).cast("long")
    one = F.transform("words", lambda w: F.pmod(F.xxhash64(w), size).cast("int"))
    left = F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))
    two = F.transform(
        left, lambda w, i: F.pmod(F.xxhash64(w, F.get(F.col("words"), i + 1)), size).cast("int")
    )
    return F.concat(one, two)


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ``words``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", words(F.col("text")).alias("words"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        lines.alias("lines"),
    )
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    hashed = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    windows = read.withColumn("windows", hashed)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = windows.withColumn(
        "placed", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    twice = F.filter(
        "placed",
        lambda x, k: (F.get(F.col("placed"), k - 1)["h"] == x["h"]) | (F.get(F.col("placed"), k + 1)["h"] == x["h"]),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.filter(twice, lambda x: x.isNotNull()), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
    ))))
    counted = ordered.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return fixed(counted.withColumn("base_failed", failed))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, one array of ``buckets`` smoothed log ratios target / raw.

    ``docs`` has doc_id and text, ``trusted`` the ids of the target documents.
    """
    marks = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(1).cast("long"))
    marks = marks.hint("merge")  # one plan at every size: the labels grow with the documents
    marked = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    grams = marked.select(words(F.col("text")).alias("words"), F.coalesce("target", F.lit(0)).alias("target"))
    counts = (
        grams.select("target", F.explode(_grams(buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    listed = full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"),
        F.sum("raw").alias("raw"), F.sum("target").alias("target"),
    )
    ratio = F.transform("all", lambda b: (
        F.log((b["target"] + 1) / (F.col("target") + buckets)) - F.log((b["raw"] + 1) / (F.col("raw") + buckets))
    ))
    return listed.select(ratio.alias("ratio"))


def score_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``score`` and ``kept``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = log_ratios(own, trusted, buckets).scalar()
    graded = base_rules(own).withColumns({"grams": _grams(buckets), "ratio": table})
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(F.col("ratio"), b))
    scored = graded.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return fixed(scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "score", kept.alias("kept"),
    ))
