"""Segmentation, greedy windows and display timing queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cueloom.operators import intervals, ordered, segments, timing
from cueloom.plans.registry import query
from cueloom.sources import tables as t

CUE_KEY = (["episode_id"], ["cue_id"])
TOK_KEY = (["episode_id"], ["cue_id", "tok"])


def cue_blocks(spark, sf):
    return ordered.dense_blocks(t.cue(spark, sf), "cue_id")


def token_blocks(spark, sf):
    """Blocks of 64 cues: bounded by 64 texts whatever the episode's size."""
    return ordered.dense_blocks(t.token(spark, sf), "cue_id", 64)


@query("win1_scene_gap", "WITH " + t.CUE_SQL + """,
f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w >= 3000 OR lag(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM cue WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id))
SELECT episode_id, cue_id, CAST(sum(o) OVER (PARTITION BY episode_id ORDER BY cue_id) AS BIGINT) AS scene FROM f""")
def scene_gap(spark, sf):
    return segments.scenes_by_gap(cue_blocks(spark, sf), *CUE_KEY).select("episode_id", "cue_id", "scene")


@query("win1_scene_caps", "WITH RECURSIVE " + t.CUE_SQL + """,
q AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY cue_id) AS k FROM cue),
st AS (SELECT episode_id, cue_id, k, end_ms, 1 AS n, length(text) AS ch, 1 AS scene FROM q WHERE k = 1
 UNION ALL SELECT c.episode_id, c.cue_id, c.k, c.end_ms,
  CASE WHEN s.n >= 3 OR s.ch + length(c.text) > 900 OR c.start_ms - s.end_ms >= 3000 THEN 1 ELSE s.n + 1 END,
  CASE WHEN s.n >= 3 OR s.ch + length(c.text) > 900 OR c.start_ms - s.end_ms >= 3000 THEN length(c.text) ELSE s.ch + length(c.text) END,
  CASE WHEN s.n >= 3 OR s.ch + length(c.text) > 900 OR c.start_ms - s.end_ms >= 3000 THEN s.scene + 1 ELSE s.scene END
 FROM st s JOIN q c ON c.episode_id = s.episode_id AND c.k = s.k + 1)
SELECT episode_id, cue_id, CAST(scene AS BIGINT) AS scene FROM st""")
def scene_caps(spark, sf):
    return segments.scenes_with_caps(cue_blocks(spark, sf), *CUE_KEY, max_rows=3, max_chars=900).select(
        "episode_id", "cue_id", "scene"
    )


@query("win2_utterances", "WITH " + t.TOKEN_SQL + """,
f AS (SELECT *, CASE WHEN coalesce(lag(regexp_matches(text, '[。！？!?][」』）)]?$')) OVER w, true) THEN 1 ELSE 0 END AS o
      FROM token WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id, tok))
SELECT episode_id, cue_id, tok, CAST(sum(o) OVER (PARTITION BY episode_id ORDER BY cue_id, tok) AS BIGINT) AS utterance FROM f""")
def utterances(spark, sf):
    return segments.utterances(token_blocks(spark, sf), *TOK_KEY).select("episode_id", "cue_id", "tok", "utterance")


@query("win3_display_groups", "WITH RECURSIVE " + t.TOKEN_SQL + """,
tk AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY cue_id, tok) AS k, length(text) AS n,
       regexp_matches(text, '[。！？!?][」』）)]?$') AS cl FROM token),
st AS (SELECT episode_id, k, start_ms AS g0, end_ms AS e, n AS ch, cl, 1 AS grp FROM tk WHERE k = 1
 UNION ALL SELECT episode_id, k, CASE WHEN o THEN s0 ELSE g0 END, e1, CASE WHEN o THEN n ELSE ch + n END, c1, CASE WHEN o THEN grp + 1 ELSE grp END
 FROM (SELECT c.episode_id, c.k, s.g0, c.start_ms AS s0, c.end_ms AS e1, c.n, s.ch, c.cl AS c1, s.grp,
   s.cl OR c.start_ms - s.e >= 550 OR c.end_ms - s.g0 > 6000 OR s.ch + c.n > 38 AS o
   FROM st s JOIN tk c ON c.episode_id = s.episode_id AND c.k = s.k + 1))
SELECT k.episode_id, k.cue_id, k.tok, CAST(st.grp AS BIGINT) AS group_no FROM st JOIN tk k ON k.episode_id = st.episode_id AND k.k = st.k""")
def display_groups(spark, sf):
    return segments.display_groups(token_blocks(spark, sf), *TOK_KEY).select("episode_id", "cue_id", "tok", "group_no")


_MARKS = """, gp AS (SELECT user_id, (e_ms + lead(s_ms) OVER (PARTITION BY user_id ORDER BY s_ms)) // 2 AS p FROM speech),
rng AS (SELECT user_id, min(s_ms) AS lo, max(e_ms) AS hi FROM speech GROUP BY 1),
st AS (SELECT user_id, lo AS a, hi, 0 AS depth FROM rng
 UNION ALL SELECT s.user_id, coalesce(max(g.p), s.a + 21600000), s.hi, s.depth + 1 FROM st s
  LEFT JOIN gp g ON g.user_id = s.user_id AND g.p >= s.a + 14040000 AND g.p <= s.a + 21600000 WHERE s.hi - s.a > 21600000 GROUP BY s.user_id, s.a, s.hi, s.depth)"""


@query("win4_greedy_windows", "WITH RECURSIVE " + t.SPEECH_SQL + _MARKS + """,
w AS (SELECT user_id, a AS core_start, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), hi) AS core_end, hi, min(a) OVER (PARTITION BY user_id) AS lo FROM st)
SELECT user_id, core_start, core_end, greatest(core_start - 800, lo) AS start_ms, least(core_end + 800, hi) AS end_ms FROM w""")
def greedy_windows(spark, sf):
    """Six-hour windows over each user's activity, cut at silence centres."""
    raw = t.activity(spark, sf)
    span = raw.groupBy("user_id").agg(F.min("s_ms").alias("lo"), F.max("e_ms").alias("hi"))
    edges = span.select("user_id", F.inline(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("kind"))
    )))
    gaps = intervals.silence_gaps(raw, ["user_id"], "s_ms", "e_ms", "event_id")
    marks = edges.unionByName(gaps.select("user_id", F.col("centre").alias("at"), F.lit(1).alias("kind")))
    return segments.greedy_windows(marks, ["user_id"], "at", "kind", 21_600_000, 800)


@query("win5_short_cores", "WITH RECURSIVE " + t.OWNER_SQL + """,
gp AS (SELECT DISTINCT doc_id // 20 AS owner_id, (doc_id // 20) * 20000 + (n_chars * 37) % 20000 AS x FROM documents),
st AS (SELECT owner_id, end_ms, start_ms AS a, 1 AS n FROM owner
 UNION ALL SELECT s.owner_id, s.end_ms, coalesce(arg_min(g.x, abs(g.x - s.a - 6000) * 100000000000 + g.x), least(s.a + 6000, least(s.a + 8000, s.end_ms - 2000))), s.n + 1
  FROM st s LEFT JOIN gp g ON g.owner_id = s.owner_id AND g.x >= s.a + 2000 AND g.x <= least(s.a + 8000, s.end_ms - 2000)
  WHERE s.end_ms - s.a > 8000 GROUP BY s.owner_id, s.end_ms, s.a, s.n)
SELECT owner_id, CAST(n AS BIGINT) AS core_no, a AS core_start, coalesce(lead(a) OVER (PARTITION BY owner_id ORDER BY n), end_ms) AS core_end FROM st""")
def short_cores(spark, sf):
    gaps = t.table(spark, sf, "documents").select(
        F.expr("doc_id div 20").alias("owner_id"), F.expr("(doc_id div 20) * 20000 + (n_chars * 37) % 20000").alias("x")
    )
    return segments.short_cores(t.owner(spark, sf), gaps, "owner_id", "start_ms", "end_ms", "x")


@query("win6_energy_cuts")
def energy_cuts(spark, sf):
    """Order lines of a supplier as its signal: quantity is the sample, 4 frames a unit."""
    lines = t.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("x")
    )
    placed = ordered.dense_rank_positions(lines, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "k")
    frames = placed.select("l_suppkey", (F.col("k") - 1).alias("frame"), "x")
    total = frames.groupBy("l_suppkey").agg(F.count("*").alias("total"))
    power = segments.moving_power(frames, ["l_suppkey"], "frame", "x", 2).join(total, "l_suppkey")
    return segments.energy_cuts(power, ["l_suppkey"], "frame", "power", "total", 4)


_PAUSE = """,
c2 AS (SELECT *, lead(start_ms) OVER w - end_ms AS gap, lead(start_ms) OVER w AS nx,
  sum(n_lex) OVER (PARTITION BY episode_id) - sum(n_lex) OVER w AS rest FROM cue WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id)),
sp AS (SELECT episode_id, start_ms - 700 * (cue_id % 3) AS a, end_ms AS b FROM cue),
c3 AS (SELECT c.episode_id, c.cue_id, row_number() OVER (PARTITION BY c.episode_id ORDER BY c.cue_id) AS k, c.n_lex, c.rest, c.gap, (SELECT coalesce(sum(greatest(0, least(c.nx, s.b) - greatest(c.end_ms, s.a))), 0) FROM sp s WHERE s.episode_id = c.episode_id AND s.a < c.nx AND s.b > c.end_ms) AS speech FROM c2 c WHERE gap IS NOT NULL),
rec AS (SELECT episode_id, CAST(0 AS BIGINT) AS cue_id, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS held, 0 AS cnt, false AS cut, CAST(0 AS HUGEINT) AS gap, CAST(0 AS HUGEINT) AS speech FROM (SELECT DISTINCT episode_id FROM cue)
 UNION ALL SELECT c.episode_id, c.cue_id, c.k, CASE WHEN ok THEN 0 ELSE c.h END, CASE WHEN ok THEN cnt + 1 ELSE cnt END, ok, c.gap, c.speech
 FROM (SELECT x.*, r.cnt, r.held + x.n_lex AS h, x.gap >= 2000 AND x.speech * 5 <= x.gap AND least(r.held + x.n_lex, x.rest) >= 2 AS ok
   FROM rec r JOIN c3 x ON x.episode_id = r.episode_id AND x.k = r.k + 1) c)"""


@query("win8_pause_cuts", "WITH RECURSIVE " + t.CUE_SQL + _PAUSE + """
SELECT episode_id, cue_id, CAST(gap AS BIGINT) AS gap_ms, CAST(speech AS BIGINT) AS speech_ms FROM rec WHERE cut""")
def pause_cuts(spark, sf):
    """Cues as the aligned pieces of an episode; detected speech reaches before some cues."""
    cues = cue_blocks(spark, sf).drop("text")
    seen = ordered.scan(
        cues, ["episode_id"], ["cue_id"], lead={"nx": F.col("start_ms")}, before={"lex_before": F.col("n_lex")}
    ).filter("nx IS NOT NULL")
    total = cues.groupBy("episode_id").agg(F.sum("n_lex").alias("total"))
    gaps = seen.join(total, "episode_id").select(
        "episode_id", "cue_id", ordered.BLOCK, F.col("n_lex").alias("lex"),
        F.expr("total - lex_before - n_lex").alias("rest_lex"), F.expr("nx - end_ms").alias("gap_ms"),
        F.col("end_ms").alias("g0"), F.col("nx").alias("g1"),
    )
    speech = cues.select(
        "episode_id", F.expr("greatest(0, start_ms - 700 * (cue_id % 3))").alias("a"), F.col("end_ms").alias("b")
    )
    open_gaps = gaps.filter("g1 > g0").drop("lex", "rest_lex", "gap_ms", ordered.BLOCK)
    heard = intervals.covered(open_gaps, speech, ["episode_id"], ["cue_id"], ("g0", "g1"), ("a", "b"), "speech_ms")
    ready = gaps.join(heard.select("episode_id", "cue_id", "speech_ms"), ["episode_id", "cue_id"], "left")
    ready = ready.withColumn("speech_ms", F.coalesce("speech_ms", F.lit(0)).cast("bigint"))
    return segments.pause_cuts(ready, *CUE_KEY)


_MOVED = """,
mv AS (SELECT episode_id, cue_id, text, greatest(0, start_ms - CASE WHEN cue_id % 3 = 0 THEN 900 ELSE 0 END) AS s, end_ms - CASE WHEN cue_id % 4 = 1 THEN 600 ELSE 0 END AS e,
  greatest(800, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) * 1000 // 9) AS need FROM cue),
o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s, e, cue_id) AS k FROM mv),"""


def _moved(spark, sf):
    rows = t.cue(spark, sf).select(
        "episode_id", "cue_id", "text",
        F.expr("greatest(0L, start_ms - CASE WHEN cue_id % 3 = 0 THEN 900 ELSE 0 END)").alias("start_ms"),
        F.expr("end_ms - CASE WHEN cue_id % 4 = 1 THEN 600 ELSE 0 END").alias("end_ms"),
    )
    return rows.withColumns({"at_start": F.col("start_ms"), "at_end": F.col("end_ms")})


@query("win9_final_timing", "WITH RECURSIVE " + t.CUE_SQL + _MOVED.replace("\\\\", "\\") + """
p1 AS (SELECT episode_id, k, s, e, s AS raw, false AS pu FROM o WHERE k = 1
 UNION ALL SELECT episode_id, k, s1, CASE WHEN pu THEN greatest(e, s1 + 200) ELSE e END, s, pu FROM (
  SELECT c.episode_id, c.k, c.e, c.s, c.s < p.e + 40 AS pu,
    CASE WHEN c.s < p.e + 40 THEN greatest(c.s, greatest(p.s + 200, c.s - 40) + 40) ELSE c.s END AS s1
  FROM p1 p JOIN o c ON c.episode_id = p.episode_id AND c.k = p.k + 1)),
p2 AS (SELECT *, CASE WHEN lead(pu) OVER w THEN greatest(s + 200, lead(raw) OVER w - 40) ELSE e END AS e1, lead(s) OVER w AS ns FROM p1 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p3 AS (SELECT p2.*, o.need, o.cue_id, greatest(e1, least(p2.s + o.need, coalesce(ns - 40, p2.s + o.need))) AS e2 FROM p2 JOIN o ON o.episode_id = p2.episode_id AND o.k = p2.k),
p4 AS (SELECT *, CASE WHEN e2 - s < need THEN greatest(coalesce(lag(e2) OVER w + 40, 0), least(s, e2 - need)) ELSE s END AS s2 FROM p3 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p5 AS (SELECT *, greatest(e2, least(e2 + 300, coalesce(lead(s2) OVER w - 40, e2 + 300))) AS e3 FROM p4 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p6 AS (SELECT *, e3 - s2 > greatest(7000, need) AS capped FROM p5)
SELECT episode_id, cue_id, CAST(s2 AS BIGINT) AS start_ms, CAST(CASE WHEN capped THEN s2 + greatest(7000, need) ELSE e3 END AS BIGINT) AS end_ms, capped,
  CASE WHEN capped THEN s2 + greatest(7000, need) ELSE e3 END - s2 < need AS below_minimum FROM p6""")
def final_timing(spark, sf):
    cut = ordered.range_blocks(_moved(spark, sf), ["episode_id"], ["at_start", "at_end", "cue_id"])
    done = timing.finalize(cut, ["episode_id"], ["at_start", "at_end", "cue_id"])
    return done.drop("at_start", "at_end", "placed")


@query("win9_media_end", "WITH RECURSIVE " + t.CUE_SQL + """,
md AS (SELECT episode_id, max(end_ms) - 1500 * (episode_id % 4) AS media FROM cue GROUP BY 1),
mv AS (SELECT episode_id, cue_id, text, greatest(0, start_ms - CASE WHEN cue_id % 3 = 0 THEN 900 ELSE 0 END) AS s,
  least(media, end_ms - CASE WHEN cue_id % 4 = 1 THEN 600 ELSE 0 END) AS e, media,
  greatest(800, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) * 1000 // 9) AS need FROM cue JOIN md USING (episode_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s, e, cue_id) AS k FROM mv),
p1 AS (SELECT episode_id, k, s, e, s AS raw, false AS pu FROM o WHERE k = 1
 UNION ALL SELECT episode_id, k, s1, CASE WHEN pu THEN greatest(e, s1 + 200) ELSE e END, s, pu FROM (
  SELECT c.episode_id, c.k, c.e, c.s, c.s < p.e + 40 AS pu,
    CASE WHEN c.s < p.e + 40 THEN greatest(c.s, greatest(p.s + 200, c.s - 40) + 40) ELSE c.s END AS s1
  FROM p1 p JOIN o c ON c.episode_id = p.episode_id AND c.k = p.k + 1)),
p2 AS (SELECT *, CASE WHEN lead(pu) OVER w THEN greatest(s + 200, lead(raw) OVER w - 40) ELSE e END AS e1, lead(s) OVER w AS ns FROM p1 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p3 AS (SELECT p2.*, o.need, o.cue_id, o.media, greatest(e1, least(p2.s + o.need, coalesce(ns - 40, media))) AS e2 FROM p2 JOIN o ON o.episode_id = p2.episode_id AND o.k = p2.k),
p4 AS (SELECT *, CASE WHEN e2 - s < need THEN greatest(coalesce(lag(e2) OVER w + 40, 0), least(s, e2 - need)) ELSE s END AS s2 FROM p3 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p5 AS (SELECT *, greatest(e2, least(e2 + 300, coalesce(lead(s2) OVER w - 40, media))) AS e3 FROM p4 WINDOW w AS (PARTITION BY episode_id ORDER BY k)),
p6 AS (SELECT *, e3 - s2 > greatest(7000, need) AS capped FROM p5),
p7 AS (SELECT *, CASE WHEN capped THEN s2 + greatest(7000, need) ELSE e3 END AS fin FROM p6),
p8 AS (SELECT *, fin > s2 AND s2 >= coalesce(lag(fin) OVER (PARTITION BY episode_id ORDER BY k), s2) AS placed FROM p7)
SELECT episode_id, count(*) AS cues, count(*) FILTER (NOT placed) AS unplaced, CASE WHEN bool_and(placed) THEN 'placed' ELSE 'cannot_place' END AS outcome,
  min(cue_id) FILTER (NOT placed) AS first_unplaced, CAST(sum(fin - s2) AS BIGINT) AS shown_ms, CAST(max(fin) AS BIGINT) AS last_end, count(*) FILTER (fin - s2 < need) AS below_minimum
FROM p8 GROUP BY 1""")
def media_end_timing(spark, sf):
    """Episodes whose medium ends before some of their cues do: what fits, and which cannot be placed."""
    cues = _moved(spark, sf)
    media = t.cue(spark, sf).groupBy("episode_id").agg((F.max("end_ms") - 1500 * (F.col("episode_id") % 4)).alias("media"))
    cut = cues.join(media, "episode_id").withColumn("end_ms", F.least("end_ms", "media")).withColumn("at_end", F.col("end_ms"))
    order = ["at_start", "at_end", "cue_id"]
    done = timing.finalize(ordered.range_blocks(cut, ["episode_id"], order), ["episode_id"], order, "media")
    return done.groupBy("episode_id").agg(
        F.count("*").alias("cues"), F.count_if(~F.col("placed")).alias("unplaced"),
        F.when(F.bool_and("placed"), "placed").otherwise("cannot_place").alias("outcome"),
        F.min(F.when(~F.col("placed"), F.col("cue_id"))).alias("first_unplaced"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("shown_ms"), F.max("end_ms").alias("last_end"),
        F.count_if("below_minimum").alias("below_minimum"),
    )


@query("win14_flash_merge")
def flash_merge(spark, sf):
    """Word tokens as display rows; flashes join their neighbour inside the cue."""
    tokens = token_blocks(spark, sf)
    placed = timing.merge_flashes(tokens, *TOK_KEY, "cue_id")
    shown = placed.join(
        tokens.select("episode_id", "cue_id", "tok", "text", "start_ms", "end_ms"), ["episode_id", "cue_id", "tok"]
    )
    parts = shown.groupBy("episode_id", "display_no").agg(
        F.min("cue_id").alias("cue_id"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "tok").alias("end_ms"),
        F.array_sort(F.collect_list(F.struct("tok", "text"))).alias("parts"),
    )
    return parts.select(
        "episode_id", "display_no", "cue_id", "start_ms", "end_ms", F.array_join("parts.text", "").alias("text")
    )


@query("win15_display_hold", "WITH RECURSIVE " + t.CUE_SQL + """,
o AS (SELECT *, row_number() OVER w AS k, coalesce(lead(start_ms) OVER w, end_ms + 1000) AS nx, least(6000, greatest(1000, length(text) * 100)) AS want FROM cue WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id)),
st AS (SELECT DISTINCT episode_id, CAST(0 AS BIGINT) AS cue_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM cue
 UNION ALL SELECT episode_id, cue_id, k, CASE WHEN b - a < 400 THEN greatest(p, least(a, b - 800)) ELSE a END, b FROM (
  SELECT *, least(nx, greatest(end_ms, a + want)) AS b FROM (SELECT c.*, s.b AS p, greatest(s.b, c.start_ms - 80) AS a FROM st s JOIN o c ON c.episode_id = s.episode_id AND c.k = s.k + 1)))
SELECT episode_id, cue_id, a AS hold_start, b AS hold_end FROM st WHERE k > 0""")
def display_hold(spark, sf):
    return timing.hold(cue_blocks(spark, sf), *CUE_KEY)


@query("win11_repair_timing", "WITH " + t.TOKEN_SQL + r""",
a AS (SELECT *, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS lex FROM token),
b AS (SELECT *, lex > 0 AND end_ms - start_ms < 60 * lex - 100 AS bad, greatest(1, lex) AS w FROM a),
c AS (SELECT *, sum(CASE WHEN bad THEN lex ELSE 0 END) OVER p * 2 > greatest(1, sum(lex) OVER p) AS failed,
  lag(end_ms) OVER q AS pe, lead(start_ms) OVER q AS ns, tok - row_number() OVER (PARTITION BY episode_id, cue_id, bad ORDER BY tok) AS run
  FROM b WINDOW p AS (PARTITION BY episode_id, cue_id), q AS (PARTITION BY episode_id, cue_id ORDER BY tok)),
d AS (SELECT *, sum(w) OVER r AS chars, sum(w) OVER (PARTITION BY episode_id, cue_id, bad, run ORDER BY tok) AS upto,
  first(pe) OVER (PARTITION BY episode_id, cue_id, bad, run ORDER BY tok) AS bf, first(ns) OVER (PARTITION BY episode_id, cue_id, bad, run ORDER BY tok DESC) AS af,
  min(start_ms) OVER r AS s0, first(end_ms) OVER (PARTITION BY episode_id, cue_id, bad, run ORDER BY tok DESC) AS e0 FROM c WINDOW r AS (PARTITION BY episode_id, cue_id, bad, run)),
e AS (SELECT *, chars * 150 AS need, coalesce(bf, greatest(cue_start, coalesce(af - chars * 150, cue_start))) AS l FROM d),
f AS (SELECT *, coalesce(af, least(cue_end, l + need)) AS r FROM e),
g AS (SELECT *, r - l > 2 * need AS wide, least(greatest((s0 + e0) // 2, l + need // 2), r - need // 2) AS c FROM f),
h AS (SELECT *, CASE WHEN wide THEN c - need // 2 ELSE l END AS l2, CASE WHEN wide THEN c + need // 2 ELSE r END AS r2 FROM g)
SELECT episode_id, cue_id, tok, failed, CAST(CASE WHEN bad AND NOT failed THEN l2 + (r2 - l2) * (upto - w) // chars ELSE start_ms END AS BIGINT) AS start_ms,
  CAST(CASE WHEN bad AND NOT failed THEN l2 + (r2 - l2) * upto // chars ELSE end_ms END AS BIGINT) AS end_ms, bad AND NOT failed AS repaired FROM h""")
def repair_timing(spark, sf):
    return timing.repair(t.token(spark, sf), ["episode_id", "cue_id"], "tok", "text", ("cue_start", "cue_end"))


@query("win13_edit_components", "WITH " + t.EDIT_SQL + """,
f AS (SELECT episode_id, cue_id, CASE WHEN cue_id - lag(cue_id) OVER w <= 2 THEN 0 ELSE 1 END AS o FROM edit WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id))
SELECT episode_id, cue_id, CAST(sum(o) OVER (PARTITION BY episode_id ORDER BY cue_id) AS BIGINT) AS component FROM f""")
def edit_components(spark, sf):
    ids = ordered.dense_blocks(t.edit(spark, sf).select("episode_id", "cue_id"), "cue_id")
    return segments.components(ids, ["episode_id"], "cue_id", 1).select("episode_id", "cue_id", "component")


@query("win24_repeated_flags", """SELECT a.l_orderkey AS line, CAST(a.l_linenumber AS BIGINT) AS round, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey
  AND b.l_linenumber = a.l_linenumber - 1 AND b.l_returnflag <> 'N' AND a.l_linestatus = b.l_linestatus) AS unfixable FROM lineitem a WHERE a.l_returnflag <> 'N'""")
def repeated_flags(spark, sf):
    """A line flagged in two rounds running and not changed in between cannot be fixed.

    Order lines stand for review rounds; the previous round is an equi-join, not a sort.
    """
    rounds = t.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("bigint").alias("round"),
        F.col("l_linestatus").alias("state"),
    )
    before = rounds.select("line", (F.col("round") + 1).alias("round"), "state").distinct().withColumn("seen", F.lit(True))
    return rounds.join(before, ["line", "round", "state"], "left").select(
        "line", "round", F.coalesce("seen", F.lit(False)).alias("unfixable")
    )


@query("win25_section_fill", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM l),
s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\S{1,24}\.$') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM u)
SELECT doc_id, coalesce(section, '') AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(min(line_no) AS BIGINT) AS first_line FROM s GROUP BY 1, 2""")
def section_fill(spark, sf):
    """One-word lines are section headers; each line takes the last header before it."""
    lines = t.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    header = F.when(F.col("line").rlike(r"^\S{1,24}\.$"), F.col("line"))
    filled = lines.withColumn("section", F.last(header, True).over(Window.partitionBy("doc_id").orderBy("at")))
    return filled.groupBy("doc_id", F.coalesce("section", F.lit("")).alias("section")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("n_chars"),
        (F.min("at") + 1).cast("bigint").alias("first_line"),
    )
