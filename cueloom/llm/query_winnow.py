"""op9: benchmark windows found in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.registry import documents, query
from cueloom.llm.winnow import contamination


def hit_words(spans):
    """Words inside any span; spans are sorted by their first word."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    walked = F.aggregate(by_place, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["last"] - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(s["last"], acc["end"]).alias("end"),
    ))
    return walked["n"]


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least one word in ``share`` is hit."""
    counted = found.withColumn("n_hit", hit_words(F.col("spans")))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS s
       FROM (SELECT item, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS r(k)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM d, ns, unnest(range(1, len(w) - n + 2)) AS r(k)),
hit AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON iw.s = dw.s AND iw.n = dw.n),
cov AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, n)) AS x(j) GROUP BY 1),
met AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN met USING (doc_id)"""


@query("op9_winnowing", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return judged(found).select(
        "own.doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated",
    )
