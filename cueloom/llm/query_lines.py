"""op3: every document without lines that repeat an earlier one, exactly or within one word edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.llm.lines import dedup_lines
from cueloom.llm.registry import documents, query


SQL = r"""
WITH l AS (SELECT doc_id, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
           FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
f AS (SELECT array_to_string(w, ' ') AS s, w, len(w) AS n, doc_id, k, row_number() OVER (ORDER BY doc_id, k) AS rk FROM l WHERE len(w) > 0
      QUALIFY row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, k) = 1),
g AS (SELECT rk, w, n, n - d AS a FROM f, unnest([0, 1]) AS x(d) WHERE n >= 8),
h AS (SELECT rk, w, n, 'head' AS side, a, array_to_string(w[1 : a // 2], ' ') AS part FROM g
      UNION ALL SELECT rk, w, n, 'tail', a, array_to_string(w[n - (a - a // 2) + 1 : n], ' ') FROM g),
p AS (SELECT DISTINCT x.rk AS later, x.w AS lw, x.n AS ln, y.rk AS earlier, y.w AS ew, y.n AS en
      FROM h x JOIN h y ON x.side = y.side AND x.a = y.a AND x.part = y.part AND y.rk < x.rk WHERE abs(x.n - y.n) <= 1),
q AS (SELECT later, CASE WHEN ln < en THEN lw ELSE ew END AS s, CASE WHEN ln < en THEN ew ELSE lw END AS t, ln = en AS same FROM p),
o AS (SELECT *, coalesce(list_min(list_filter(range(1, len(s) + 1), lambda i: s[i] <> t[i])), len(s) + 1) AS pos FROM q),
gone AS (SELECT DISTINCT later FROM o WHERE CASE WHEN same THEN array_to_string(s[pos + 1 : len(s)], ' ') = array_to_string(t[pos + 1 : len(t)], ' ')
         ELSE array_to_string(s[pos : len(s)], ' ') = array_to_string(t[pos + 1 : len(t)], ' ') END),
kept AS (SELECT doc_id, k FROM f WHERE rk NOT IN (SELECT later FROM gone)),
m AS (SELECT l.*, len(w) > 0 AS "full", len(w) = 0 OR kept.k IS NOT NULL AS stays FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id AND kept.k = l.k)
SELECT doc_id, CAST(count(*) FILTER (WHERE "full") AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE stays), '')) AS BIGINT) AS n_chars_left,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE stays), '')) AS text_sha256
FROM m GROUP BY doc_id"""


@query("op3_line_dedup", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "own.doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )
