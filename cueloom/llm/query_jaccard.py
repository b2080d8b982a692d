"""op7: components of documents whose sets of five-word shingles overlap by three quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm.jaccard import jaccard_components
from cueloom.llm.registry import documents, query


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, least(5, len(w)) AS m FROM d WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS r(k)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT x, y FROM pr JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ed AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
re(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT re.a, ed.y FROM re JOIN ed ON ed.x = re.b)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM re LEFT JOIN sz ON sz.doc_id = a GROUP BY a"""


@query("op7_jaccard_join", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
