"""op12: the 20 best documents for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm.registry import documents, query
from cueloom.llm.search import build_index, query_terms, search

_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
h AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM h),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM h) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term, nn),
s AS (SELECT item_id, r, doc_id,
  CAST(sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term), g GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""


@query("op12_ranked_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs, _ = build_index(documents(spark, sf_dir))
    return search(index, n_docs, query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
