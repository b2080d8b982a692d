"""Dictionary readings: letters are written as ideographs without spaces, words of benchmark items are the table.

Readings fold letters that sound alike, so different ideographs have one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cueloom.functions import text as tx
from cueloom.operators import readings
from cueloom.plans.registry import query
from cueloom.sources import tables as t

_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一二三四五六七八九十百千万上下左右大中小山川田日月火"
_ALIKE = ("lvczqx", "rbksks")


def written(c: str):
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), _LATIN, _HAN)


def word_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, reading, cost): a word is cheaper the more items hold it."""
    words = t.alias_words(spark, sf_dir).filter(F.col("surface").rlike("^[a-z]{2,}$"))
    return words.groupBy("surface").agg(F.count("*").alias("n")).select(
        written("surface").alias("surface"), F.translate("surface", *_ALIKE).alias("reading"),
        F.expr("2000 + 8000 div n").alias("cost"),
    )


_LEX = t.ALIAS_SQL + f""",
lex AS (SELECT surface, translate(surface, '{_ALIKE[0]}', '{_ALIKE[1]}') AS r, 2000 + 8000 // count(*) AS c FROM alias WHERE regexp_matches(surface, '^[a-z]{{2,}}$') GROUP BY 1),
top AS (SELECT coalesce(max(length(surface)), 1) AS n FROM lex)"""


def _lattice(source: str) -> str:
    """SQL of ``w`` (id, t, words of ``source`` in order): costs from the right, then the path from the left."""
    return f"""
src AS (SELECT id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM ({source})),
ar AS MATERIALIZED (SELECT id, i, list({{'l': l, 'c': c}}) AS a FROM (
   SELECT id, i, l, substr(t, i, l) AS piece FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM src), (SELECT unnest(range(1, n + 1)) AS l FROM top) WHERE i + l - 1 <= length(t)
 ) JOIN lex ON surface = piece GROUP BY 1, 2),
d AS (SELECT id, CAST(length(t) AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS st, CAST(0 AS BIGINT) AS l, false AS k FROM src
 UNION ALL
 SELECT id, i - 1, list_prepend(b.c, st)[1:(SELECT n FROM top)], -b.n, b.u = 0
 FROM (SELECT d.id, d.i, d.st, list_sort(list_append(
    list_transform(coalesce(a, []), lambda x: {{'c': d.st[x.l] + x.c, 'u': 0, 'n': -x.l}}),
    {{'c': d.st[1] + {readings.UNKNOWN}, 'u': 1, 'n': CAST(-1 AS BIGINT)}}))[1] AS b
   FROM d LEFT JOIN ar ON ar.id = d.id AND ar.i = d.i WHERE d.i > 0)),
way AS MATERIALIZED (SELECT id, i, l, k FROM d WHERE l > 0),
f AS (SELECT way.* FROM way WHERE i = 0 UNION ALL SELECT way.* FROM f JOIN way ON way.id = f.id AND way.i = f.i + f.l),
one AS (SELECT f.id, f.i, f.k, substr(t, f.i + 1, f.l) AS s FROM f JOIN src ON src.id = f.id),
wl AS (SELECT id, list({{'s': s, 'r': coalesce(CASE WHEN k THEN lex.r END, translate(s, '{_LATIN}', '{_HAN}')), 'k': k, 'i': i}} ORDER BY i) AS w
  FROM one LEFT JOIN lex ON lex.surface = one.s GROUP BY 1),
w AS (SELECT src.id, t, coalesce(w, []) AS w FROM src LEFT JOIN wl ON wl.id = src.id)"""


_LINES = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"
_SAID = "array_to_string(list_transform(w, lambda x: x.r), '')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", written("text").alias("said"))
    return readings.read_words(said, "said", word_readings(spark, sf_dir), ["conv_id", "turn", "said"])


@query("txt2_dictionary_reading", "WITH RECURSIVE " + _LEX + "," + _lattice(_LINES) + f"""
SELECT id // 1000 AS conv_id, id % 1000 AS turn, sha256({_SAID}) AS reading_sha, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(w, lambda x: x.k)) AS BIGINT) AS known FROM w""")
def dictionary_reading(spark, sf):
    """Reading normal form of every line from the cheapest division into words of the table."""
    return _lines(spark, sf).select(
        "conv_id", "turn", F.sha2(readings.reading_of("words"), 256).alias("reading_sha"), F.size("words").cast("long").alias("words"),
        F.size(F.filter("words", lambda w: w["known"])).cast("long").alias("known"),
    )


@query("jn13_title_readings", "WITH RECURSIVE " + _LEX + "," + _lattice(_LINES + r""" UNION ALL
  SELECT -1 - page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) FROM pages WHERE page_id IN (SELECT conv_id FROM conversations)""") + f""",
tk AS (SELECT conv_id, x.r AS r, arg_min(x.s, x.i) AS s FROM (SELECT -1 - id AS conv_id, unnest(w) AS x FROM w WHERE id < 0) WHERE length(x.r) >= 2 GROUP BY 1, 2),
ln AS (SELECT id // 1000 AS conv_id, id % 1000 AS turn, t, {_SAID} AS r FROM w WHERE id >= 0)
SELECT ln.conv_id, turn, string_agg(translate(s, '{_LATIN}', '{_HAN}') || '(' || tk.r || ')', '/' ORDER BY translate(s, '{_LATIN}', '{_HAN}') || '(' || tk.r || ')') AS notes
FROM ln JOIN tk ON tk.conv_id = ln.conv_id WHERE contains(ln.r, tk.r) AND NOT contains(t, s) GROUP BY 1, 2""")
def title_readings(spark, sf):
    """Lines that hold the reading of a title word of their work, written otherwise."""
    works = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id")).distinct()
    titles = t.table(spark, sf, "pages").join(works, "page_id", "left_semi").select(
        F.col("page_id").alias("conv_id"), written(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title")
    )
    named = readings.read_words(titles, "title", word_readings(spark, sf), ["conv_id"])
    notes = readings.homophone_notes(_lines(spark, sf), named, "said", "conv_id", ["conv_id", "turn"])
    return notes.select("conv_id", "turn", F.array_join("notes", "/").alias("notes"))


@query("txt22_ideograph_conflict", "WITH RECURSIVE " + _LEX + "," + t.PAIR_SQL + "," + _lattice("""
SELECT 2 * (episode_id * 1000 + cue_id) AS id, source AS text FROM pair UNION ALL
SELECT 2 * (episode_id * 1000 + cue_id) + 1, CASE WHEN cue_id % 4 = 2 THEN translate(lower(source), 'lc', 'rk') ELSE source END FROM pair""") + f""",
r AS (SELECT id // 2 AS id, id % 2 AS side, t, {_SAID} AS r FROM w)
SELECT a.id // 1000 AS episode_id, a.id % 1000 AS cue_id, a.r = b.r AND a.t <> '' AND b.t <> '' AND a.t <> b.t AS conflict
FROM r a JOIN r b ON b.id = a.id AND a.side = 0 AND b.side = 1""")
def ideograph_conflict(spark, sf):
    """A line against another writing of it: the same reading in other ideographs."""
    table = word_readings(spark, sf)
    other = F.when(F.col("cue_id") % 4 == 2, F.translate(F.lower("source"), "lc", "rk")).otherwise(F.col("source"))
    both = t.pair(spark, sf).select("episode_id", "cue_id", written("source").alias("a"), written(other).alias("b"))
    keep = ["episode_id", "cue_id", "a", "b"]
    # The first side goes on as its reading: its words would be many times the text.
    left = readings.read_words(both, "a", table, keep).select(*keep, readings.reading_of("words").alias("a_reading"))
    read = readings.read_words(left, "b", table, [*keep, "a_reading"])
    conflict = readings.reading_conflict(F.col("a"), F.col("b"), F.col("a_reading"), readings.reading_of("words"))
    return read.select("episode_id", "cue_id", conflict.alias("conflict"))
