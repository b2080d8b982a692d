"""Unit and piece layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.operators import layout
from cueloom.plans.registry import query
from cueloom.sources import tables as t

IDS = ["episode_id", "cue_id"]


def marked(c: str):
    """Latin punctuation as the full-width marks the display rules know."""
    return F.translate(F.col(c), ".,;:", "。，；：")


@query("win20_sentence_units", "WITH " + t.TOKEN_SQL + r""",
e AS (SELECT *, CASE WHEN regexp_matches(text, '[。？！?!][」』）)”’ ]*$') THEN 1 ELSE 0 END AS x FROM token),
g AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY episode_id, cue_id ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw FROM e),
u AS (SELECT episode_id, cue_id, raw, string_agg(text, '' ORDER BY tok) AS text, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n FROM g GROUP BY 1, 2, 3),
m AS (SELECT *, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS lex, regexp_matches(text, '[。？！?!…][」』）)”’ ]*$') AS done FROM u),
o AS (SELECT *, CASE WHEN lex = 0 OR (lex < 2 AND NOT done) OR (row_number() OVER w = 2 AND first(lex) OVER w = 0) THEN 0 ELSE 1 END AS o FROM m WINDOW w AS (PARTITION BY episode_id, cue_id ORDER BY raw)),
f AS (SELECT *, greatest(1, sum(o) OVER (PARTITION BY episode_id, cue_id ORDER BY raw)) AS unit_no FROM o)
SELECT episode_id, cue_id, CAST(unit_no AS BIGINT) AS unit_no, string_agg(text, '' ORDER BY raw) AS text, min(s) AS start_ms, max(e) AS end_ms, CAST(sum(n) AS BIGINT) AS tokens FROM f GROUP BY 1, 2, 3""")
def sentence_units(spark, sf):
    return layout.sentence_units(t.token(spark, sf), IDS, "tok")


@query("win21_split_pieces")
def split_pieces(spark, sf):
    cues = t.cue(spark, sf).select(*IDS, marked("text").alias("said"), "start_ms", "end_ms")
    return layout.split_pieces(cues.withColumnsRenamed({"start_ms": "lo", "end_ms": "hi"}), IDS, "said", "lo", "hi")


@query("win22_place_pieces")
def place_pieces(spark, sf):
    """Each cue's text on its own sentence units, which every fifth pause separates."""
    units = layout.sentence_units(t.token(spark, sf), IDS, "tok")
    spans = units.groupBy(*IDS).agg(F.array_sort(F.collect_list(F.struct("unit_no", "start_ms", "end_ms"))).alias("u"))
    begin = F.transform("u", lambda x: x["start_ms"] + F.when(x["unit_no"] % 5 == 0, F.least(F.lit(1200), x["end_ms"] - x["start_ms"] - 10)).otherwise(0))
    rows = t.cue(spark, sf).select(*IDS, marked("text").alias("text")).join(spans, IDS)
    return layout.place_pieces(rows.select(*IDS, F.col("text").alias("said"), begin.alias("lo"), F.col("u.end_ms").alias("hi")), IDS, "said", "lo", "hi")


_SENT = r"regexp_extract_all(replace({0}, '.', '。'), '(?s)(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}].*?(?:…*[。？！?!]+[」』）)”’]*|\z)(?:[^\p{{L}}\p{{N}}]+\z)?)|(?:.+)')"


@query("win23_share_partition", "WITH " + t.PAIR_SQL + r""",
us AS (SELECT episode_id, cue_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS no FROM (SELECT episode_id, cue_id, """ + _SENT.format("source") + r""" AS l FROM pair)),
ps AS (SELECT episode_id, cue_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS no FROM (SELECT episode_id, cue_id, """ + _SENT.format("target") + r""" AS l FROM pair)),
uw AS (SELECT *, greatest(1, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS w FROM us), pw AS (SELECT *, greatest(1, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS w FROM ps),
a AS (SELECT *, sum(w) OVER (PARTITION BY episode_id, cue_id ORDER BY no) AS hi, sum(w) OVER q AS al, count(*) OVER q AS n FROM uw WINDOW q AS (PARTITION BY episode_id, cue_id)),
b AS (SELECT *, sum(w) OVER (PARTITION BY episode_id, cue_id ORDER BY no) AS hi, sum(w) OVER q AS al, count(*) OVER q AS n FROM pw WINDOW q AS (PARTITION BY episode_id, cue_id)),
h AS (SELECT a.episode_id, a.cue_id, a.no AS u, b.no AS p FROM a JOIN b ON a.episode_id = b.episode_id AND a.cue_id = b.cue_id AND CASE WHEN a.n = b.n THEN a.no = b.no ELSE
  (a.hi - a.w) * 2 * b.al <= (b.hi + b.hi - b.w) * a.al AND (b.hi + b.hi - b.w) * a.al < a.hi * 2 * b.al END),
g AS (SELECT a.episode_id, a.cue_id, a.no AS u, greatest(1, sum(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.episode_id = a.episode_id AND h.cue_id = a.cue_id AND h.u = a.no) THEN 1 ELSE 0 END) OVER (PARTITION BY a.episode_id, a.cue_id ORDER BY a.no)) AS grp FROM a)
SELECT g.episode_id, g.cue_id, CAST(grp AS BIGINT) AS group_no, min(g.u) AS first_unit, max(g.u) AS last_unit, min(h.p) AS first_piece, max(h.p) AS last_piece
FROM g LEFT JOIN h ON h.episode_id = g.episode_id AND h.cue_id = g.cue_id AND h.u = g.u GROUP BY 1, 2, 3""")
def share_partition(spark, sf):
    pairs = t.pair(spark, sf)
    cut = lambda c, no: pairs.select(*IDS, F.posexplode(tx.sentences(F.replace(c, F.lit("."), F.lit("。")))).alias("_at", "text")).select(*IDS, (F.col("_at") + 1).cast("bigint").alias(no), "text")
    return layout.share_partition(cut("source", "unit_no"), cut("target", "piece_no"), IDS)


