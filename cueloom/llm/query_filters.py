"""op11: what five filters remove in all 120 orders, by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.filters import audit_filters
from cueloom.llm.registry import documents, query


def failures() -> dict:
    """The conditions of filters A to D."""
    n = F.size("words")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.char_length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
  + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, FALSE) AS INT) AS mask FROM w),
l AS (SELECT doc_id, CAST(coalesce(max(CAST(quality = 1 AS INT)), 0) AS BIGINT) AS good, CAST(coalesce(max(CAST(toxic = 1 AS INT)), 0) AS BIGINT) AS tox
      FROM labels GROUP BY 1),
cell AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(tox), 0) AS tox FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(filter_order, step, bit, gone) AS (
  SELECT '', 0, 0, 0
  UNION ALL SELECT filter_order || substr('ABCDE', i, 1), step + 1, CAST(1 << (i - 1) AS INT), gone + bit
  FROM o, range(1, 6) AS r(i) WHERE ((gone + bit) >> (i - 1)) & 1 = 0),
full_ AS (SELECT filter_order FROM o WHERE step = 5),
s AS (SELECT full_.filter_order, o.step, o.bit, o.gone FROM full_ JOIN o ON o.step > 0 AND starts_with(full_.filter_order, o.filter_order)),
x AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (gone + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & gone > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN tox ELSE 0 END) AS toxic_lost
  FROM cell, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x"""


@query("op11_filter_audit", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), failures(), spark.read.parquet(f"{sf_dir}/labels.parquet"), copies="E")
