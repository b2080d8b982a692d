"""Interval, coverage and timing-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import intervals, ordered
from cueloom.plans.registry import query
from cueloom.sources import tables as t

GRID_MS = 120_000  # fixed value: physical window of the long grid
BIN_MS = 20_000


@query("jn3_grid_cells", "WITH " + t.CUE_SQL + """
SELECT c.episode_id, c.cue_id, cell, greatest(c.start_ms, cell * 120000) AS from_ms,
       least(c.end_ms, (cell + 1) * 120000) AS to_ms
FROM cue c, unnest(range(c.start_ms // 120000, (c.end_ms - 1) // 120000 + 1)) AS g(cell)""")
def grid_cells(spark, sf):
    cells = intervals.spread(t.cue(spark, sf), "start_ms", "end_ms", GRID_MS, "cell")
    return cells.select(
        "episode_id", "cue_id", "cell",
        F.greatest("start_ms", F.col("cell") * GRID_MS).alias("from_ms"),
        F.least("end_ms", (F.col("cell") + 1) * GRID_MS).alias("to_ms"),
    )


@query("jn1_reference_overlap", "WITH " + t.CUE_SQL + """
SELECT s.episode_id, s.cue_id, r.cue_id AS ref_id,
       least(s.end_ms, r.end_ms + 300) - greatest(s.start_ms, r.start_ms - 700) AS overlap_ms
FROM cue s JOIN cue r ON r.episode_id = s.episode_id AND r.start_ms - 700 < s.end_ms AND r.end_ms + 300 > s.start_ms
WHERE s.role = 'user' AND r.role <> 'user'""")
def reference_overlap(spark, sf):
    cues = t.cue(spark, sf)
    source = cues.filter("role = 'user'").select("episode_id", "cue_id", "start_ms", "end_ms")
    reference = cues.filter("role <> 'user'").select(
        "episode_id", F.col("cue_id").alias("ref_id"),
        (F.col("start_ms") - 700).alias("r_start"),
        (F.col("end_ms") + 300).alias("r_end"),
    )
    pairs = intervals.overlap_join(
        source, reference, ["episode_id"], ("start_ms", "end_ms"), ("r_start", "r_end"), BIN_MS
    )
    return pairs.select(
        "episode_id", "cue_id", "ref_id",
        intervals.overlap_amount("start_ms", "end_ms", "r_start", "r_end").alias("overlap_ms"),
    )


@query("jn2_speech_accounting", "WITH " + t.SPEECH_SQL + """,
win AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS w_start, epoch_us(ts) // 1000 + 10800000 AS w_end
        FROM events WHERE event_type NOT IN ('view', 'click')),
dom AS (SELECT *, greatest(0, least(w_end, 1706572800000) - w_start) AS inside FROM win),
hit AS (SELECT w.event_id, sum(greatest(0, least(w.w_end, s.e_ms, 1706572800000) - greatest(w.w_start, s.s_ms))) AS det
        FROM dom w JOIN speech s ON s.user_id = w.user_id AND s.s_ms < w.w_end AND s.e_ms > w.w_start GROUP BY 1)
SELECT d.event_id, CAST(inside AS BIGINT) AS in_domain_ms, CAST(w_end - w_start - inside AS BIGINT) AS out_of_domain_ms,
       CAST(coalesce(det, 0) AS BIGINT) AS detected_ms, CAST(inside - coalesce(det, 0) AS BIGINT) AS undetected_ms,
       CASE WHEN inside = 0 THEN -1 ELSE CAST(coalesce(det, 0) * 1000000 // inside AS BIGINT) END AS detected_ppm
FROM dom d LEFT JOIN hit h ON h.event_id = d.event_id""")
def speech_accounting(spark, sf):
    """Detected / undetected / outside split of 3 h windows; detector domain ends 30 January."""
    domain = 1706572800000
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    windows = t.table(spark, sf, "events").filter("event_type NOT IN ('view', 'click')").select(
        "event_id", "user_id", at.alias("w_start"), (at + 10800000).alias("w_end"),
    )
    speech = t.speech(spark, sf).withColumn("e_ms", F.least("e_ms", F.lit(domain))).filter("s_ms < e_ms")
    found = intervals.covered(
        windows, speech, ["user_id"], ["event_id"], ("w_start", "w_end"), ("s_ms", "e_ms"), "detected_ms"
    )
    inside = F.greatest(F.lit(0), F.least("w_end", F.lit(domain)) - F.col("w_start")).cast("bigint")
    return found.withColumn("in_domain_ms", inside).select(
        "event_id", "in_domain_ms",
        F.expr("w_end - w_start - in_domain_ms").alias("out_of_domain_ms"),
        "detected_ms", F.expr("in_domain_ms - detected_ms").alias("undetected_ms"),
        F.expr("CASE WHEN in_domain_ms = 0 THEN -1L ELSE detected_ms * 1000000 div in_domain_ms END").alias("detected_ppm"),
    )


@query("jn4_midpoint_owner", "WITH " + t.CUE_SQL + """,
cells AS (SELECT DISTINCT episode_id, cell FROM cue c, unnest(range(c.start_ms // 30000, (c.end_ms - 1) // 30000 + 1)) AS g(cell)),
hits AS (SELECT c.episode_id, c.cue_id, count(*) AS n, min(w.cell) AS window_id FROM cue c JOIN cells w
  ON w.episode_id = c.episode_id AND (c.start_ms + c.end_ms) // 2 >= w.cell * 30000 - 800
  AND (c.start_ms + c.end_ms) // 2 < (w.cell + 1) * 30000 + 800 GROUP BY 1, 2)
SELECT episode_id, cue_id, window_id FROM hits WHERE n = 1""")
def midpoint_owner(spark, sf):
    """Cues whose midpoint lies in exactly one (padded) window."""
    cues = t.cue(spark, sf)
    cells = intervals.spread(cues, "start_ms", "end_ms", 30000, "window_id").select("episode_id", "window_id").distinct()
    spans = cells.select(
        "episode_id", "window_id",
        F.greatest(F.lit(0), F.col("window_id") * 30000 - 800).cast("bigint").alias("w_start"),
        ((F.col("window_id") + 1) * 30000 + 800).alias("w_end"),
    )
    points = cues.select("episode_id", "cue_id", F.expr("(start_ms + end_ms) div 2").alias("mid"))
    hits = intervals.point_join(points, spans, ["episode_id"], "mid", ("w_start", "w_end"), 30000)
    owned = hits.groupBy("episode_id", "cue_id").agg(F.count("*").alias("n"), F.min("window_id").alias("window_id"))
    return owned.filter("n = 1").drop("n")


@query("jn10_snap_crops", "WITH " + t.CUE_SQL + """,
gap AS (SELECT episode_id, (lag(end_ms, 1, 0) OVER w + start_ms) // 2 AS x, start_ms > lag(end_ms, 1, 0) OVER w AS ok
        FROM cue WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id)),
want AS (SELECT episode_id, cue_id, start_ms, end_ms, greatest(0, least(2000, (30000 - (end_ms - start_ms)) // 2)) AS pad FROM cue),
tgt AS (SELECT *, greatest(0, start_ms - pad) AS ts, end_ms + pad AS te FROM want),
l AS (SELECT t.episode_id, cue_id, arg_min(x, (abs(x - ts) * 100000000 + x)) AS x FROM tgt t JOIN (SELECT DISTINCT episode_id, x FROM gap WHERE ok) g
      ON g.episode_id = t.episode_id AND abs(x - ts) <= 1000 AND x <= start_ms GROUP BY 1, 2),
r AS (SELECT t.episode_id, cue_id, arg_min(x, (abs(x - te) * 100000000 + x)) AS x FROM tgt t JOIN (SELECT DISTINCT episode_id, x FROM gap WHERE ok) g
      ON g.episode_id = t.episode_id AND abs(x - te) <= 1000 AND x >= end_ms GROUP BY 1, 2),
snap AS (SELECT t.*, coalesce(l.x, ts) AS a, coalesce(r.x, te) AS b FROM tgt t
         LEFT JOIN l ON l.episode_id = t.episode_id AND l.cue_id = t.cue_id
         LEFT JOIN r ON r.episode_id = t.episode_id AND r.cue_id = t.cue_id)
SELECT episode_id, cue_id, CASE WHEN b - a <= 30000 THEN a ELSE ts END AS crop_start,
       CASE WHEN b - a <= 30000 THEN b ELSE te END AS crop_end FROM snap""")
def snap_crops(spark, sf):
    """Padded crops moved to the nearest silence centre within one second, never into the core."""
    cues = ordered.dense_blocks(t.cue(spark, sf).drop("text"), "cue_id")
    seen = ordered.scan(cues, ["episode_id"], ["cue_id"], lag={"_prev": F.col("end_ms")})
    prev = F.coalesce("_prev", F.lit(0))
    marks = seen.filter(F.col("start_ms") > prev).select(
        "episode_id", F.floor((prev + F.col("start_ms")) / 2).alias("x")
    )
    pad = F.greatest(F.lit(0), F.least(F.lit(2000), F.floor((30000 - (F.col("end_ms") - F.col("start_ms"))) / 2)))
    want = cues.drop(ordered.BLOCK).withColumns(
        {"ts": F.greatest(F.lit(0), F.col("start_ms") - pad).cast("bigint"), "te": (F.col("end_ms") + pad).cast("bigint")}
    ).select("episode_id", "cue_id", "start_ms", "end_ms", "ts", "te")
    ids = (["episode_id"], ["cue_id"])
    left = intervals.nearest_boundary(want, marks, *ids, "ts", "x", 1000, F.col("x") <= F.col("start_ms"), "a")
    both = intervals.nearest_boundary(left, marks, *ids, "te", "x", 1000, F.col("x") >= F.col("end_ms"), "b")
    fits = F.col("b") - F.col("a") <= 30000
    return both.select(
        "episode_id", "cue_id",
        F.when(fits, F.col("a")).otherwise(F.col("ts")).alias("crop_start"),
        F.when(fits, F.col("b")).otherwise(F.col("te")).alias("crop_end"),
    )


@query("jn14_conflict_free", "WITH " + t.ACTIVITY_SQL + """
SELECT event_id, user_id, s_ms, e_ms FROM activity a WHERE NOT EXISTS (SELECT 1 FROM activity b
  WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND a.s_ms < b.e_ms AND b.s_ms < a.e_ms)""")
def conflict_free(spark, sf):
    return intervals.without_conflicts(t.activity(spark, sf), ["user_id"], "s_ms", "e_ms", "event_id")


@query("agg9_interval_union", "WITH " + t.SPEECH_SQL + " SELECT user_id, s_ms, e_ms FROM speech")
def interval_union(spark, sf):
    return t.speech(spark, sf)


@query("win7_silence_gaps", "WITH " + t.SPEECH_SQL + """,
n AS (SELECT user_id, e_ms AS gap_start, lead(s_ms) OVER (PARTITION BY user_id ORDER BY s_ms) AS gap_end FROM speech)
SELECT user_id, gap_start, gap_end, (gap_start + gap_end) // 2 AS centre FROM n WHERE gap_end IS NOT NULL""")
def silence_gaps(spark, sf):
    return intervals.silence_gaps(t.activity(spark, sf), ["user_id"], "s_ms", "e_ms", "event_id")


_TILES = """tile AS (SELECT owner_id, start_ms,
  end_ms + CASE WHEN owner_id % 9 = 4 THEN 15 WHEN owner_id % 9 = 5 THEN -7 WHEN owner_id % 9 = 7 THEN 12000 ELSE 0 END AS end_ms FROM owner)"""


@query("val2_window_tiling", "WITH " + t.OWNER_SQL + ", " + _TILES + """,
s AS (SELECT *, lag(end_ms) OVER (ORDER BY owner_id) AS prev, lag(owner_id) OVER (ORDER BY owner_id) AS prev_id FROM tile)
SELECT owner_id, 'gap' AS rule, start_ms - prev AS detail FROM s WHERE start_ms > prev
UNION ALL SELECT owner_id, 'overlap', start_ms - prev FROM s WHERE start_ms < prev
UNION ALL SELECT owner_id, 'late_start', start_ms FROM s WHERE prev IS NULL AND start_ms <> 0
UNION ALL SELECT owner_id, 'over_30s', end_ms - start_ms FROM s WHERE end_ms - start_ms > 30000
UNION ALL SELECT owner_id, 'id_jump', owner_id - prev_id FROM s WHERE owner_id <> prev_id + 1
UNION ALL (SELECT owner_id, 'short_of_end', (SELECT max(owner_id) * 20000 + 20000 FROM tile) - end_ms FROM s
  WHERE owner_id = (SELECT max(owner_id) FROM tile) AND abs(end_ms - (owner_id * 20000 + 20000)) > 2)""")
def window_tiling(spark, sf):
    """Windows must tile the recording: contiguous, at most 30 s, reaching its end."""
    shift = F.expr(
        "CASE WHEN owner_id % 9 = 4 THEN 15 WHEN owner_id % 9 = 5 THEN -7 WHEN owner_id % 9 = 7 THEN 12000 ELSE 0 END"
    )
    tiles = t.owner(spark, sf).withColumn("end_ms", F.col("end_ms") + shift)
    from cueloom.operators.rules import tiling_violations

    return tiling_violations(tiles, [], "owner_id", "start_ms", "end_ms", 30000, lambda last: last * 20000 + 20000, 2)


@query("val3_interval_order", "WITH " + t.ACTIVITY_SQL + """,
s AS (SELECT *, max(e_ms) OVER (PARTITION BY user_id ORDER BY s_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM activity)
SELECT user_id, event_id, 'overlap' AS rule, pk - s_ms AS detail FROM s WHERE s_ms < pk
UNION ALL SELECT user_id, event_id, 'over_4h' AS rule, e_ms - s_ms FROM s WHERE e_ms - s_ms > 14400000""")
def interval_order(spark, sf):
    cut = ordered.range_blocks(t.activity(spark, sf), ["user_id"], ["s_ms", "event_id"])
    seen = ordered.scan(cut, ["user_id"], ["s_ms", "event_id"], peak={"pk": F.col("e_ms")})
    found = F.array_compact(F.array(
        F.when(F.col("s_ms") < F.col("pk"), F.struct(F.lit("overlap").alias("rule"), F.expr("pk - s_ms").alias("detail"))),
        F.when(F.expr("e_ms - s_ms > 14400000"), F.struct(F.lit("over_4h").alias("rule"), F.expr("e_ms - s_ms").alias("detail"))),
    ))
    return seen.select("user_id", "event_id", F.inline(found))


_SHIFTED = "shifted AS (SELECT episode_id, cue_id, start_ms - CASE WHEN cue_id % 3 = 0 THEN 900 ELSE 0 END AS start_ms, end_ms - CASE WHEN cue_id % 4 = 1 THEN 600 ELSE 0 END AS end_ms FROM cue)"


@query("win10_display_lint", "WITH " + t.CUE_SQL + ", " + _SHIFTED + """,
s AS (SELECT *, lag(end_ms, 1, 0) OVER (PARTITION BY episode_id ORDER BY cue_id) AS prev FROM shifted)
SELECT episode_id, cue_id, 'nonpositive' AS kind FROM s WHERE end_ms <= start_ms
UNION ALL SELECT episode_id, cue_id, 'overlap' FROM s WHERE start_ms < prev
UNION ALL SELECT episode_id, cue_id, 'short-cue' FROM s WHERE end_ms - start_ms < 400
UNION ALL SELECT episode_id, cue_id, 'long-cue' FROM s WHERE end_ms - start_ms > 10000""")
def display_lint(spark, sf):
    from cueloom.operators.rules import display_findings

    moved = t.cue(spark, sf).select(
        "episode_id", "cue_id",
        F.expr("start_ms - CASE WHEN cue_id % 3 = 0 THEN 900 ELSE 0 END").alias("start_ms"),
        F.expr("end_ms - CASE WHEN cue_id % 4 = 1 THEN 600 ELSE 0 END").alias("end_ms"),
    )
    return display_findings(ordered.dense_blocks(moved, "cue_id"), ["episode_id"], "cue_id")


@query("agg8_coverage", "WITH " + t.CUE_SQL + """,
s AS (SELECT *, lag(end_ms, 1, 0) OVER (PARTITION BY episode_id ORDER BY cue_id) AS prev FROM cue)
SELECT episode_id, count(*) AS cues, CAST(min(end_ms - start_ms) AS BIGINT) AS min_ms, CAST(max(end_ms - start_ms) AS BIGINT) AS max_ms,
  CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, CAST(sum(end_ms - start_ms) // count(*) AS BIGINT) AS mean_ms,
  count(*) FILTER (start_ms > prev) AS gaps, count(*) FILTER (start_ms < prev) AS overlaps,
  count(*) FILTER (end_ms - start_ms > 10000) AS over_10s, CAST(max(length(text)) AS BIGINT) AS longest_text
FROM s GROUP BY episode_id""")
def coverage(spark, sf):
    cues = ordered.dense_blocks(t.cue(spark, sf), "cue_id")
    seen = ordered.scan(cues, ["episode_id"], ["cue_id"], lag={"_prev": F.col("end_ms")})
    span = F.col("end_ms") - F.col("start_ms")
    prev = F.coalesce("_prev", F.lit(0))
    return seen.groupBy("episode_id").agg(
        F.count("*").alias("cues"), F.min(span).alias("min_ms"), F.max(span).alias("max_ms"),
        F.sum(span).alias("total_ms"), F.expr("sum(end_ms - start_ms) div count(*)").alias("mean_ms"),
        F.count_if(F.col("start_ms") > prev).alias("gaps"), F.count_if(F.col("start_ms") < prev).alias("overlaps"),
        F.count_if(span > 10000).alias("over_10s"), F.max(F.length("text")).cast("bigint").alias("longest_text"),
    )


_STRATA = """
rec AS (SELECT min(s_ms) AS lo, max(e_ms) AS hi FROM speech),
cand AS (SELECT (lo // 3600000 + h) * 3600000 AS c0 FROM rec, unnest(range(0, (hi - lo) // 3600000 + 1)) AS g(h)),
usr AS (SELECT DISTINCT user_id FROM speech),
hit AS (SELECT u.user_id, c.c0, sum(least(c.c0 + 14400000, s.e_ms) - greatest(c.c0, s.s_ms)) AS det FROM usr u CROSS JOIN cand c
  JOIN speech s ON s.user_id = u.user_id AND s.s_ms < c.c0 + 14400000 AND s.e_ms > c.c0 GROUP BY 1, 2),
dom AS (SELECT h.*, (SELECT lo // 3600000 * 3600000 FROM rec) AS d0, (SELECT (hi // 3600000 + 1) * 3600000 FROM rec) AS d1 FROM hit h WHERE det >= 1440000),
str AS (SELECT *, (c0 + 7200000 - d0) * 8 // (d1 - d0) AS stratum FROM dom),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, stratum ORDER BY abs(16 * (c0 + 7200000 - d0) - (2 * stratum + 1) * (d1 - d0)), c0) AS rn FROM str WHERE stratum BETWEEN 0 AND 7)"""


@query("win18_stratified_windows", "WITH " + t.SPEECH_SQL + ", " + _STRATA + """
SELECT user_id, CAST(stratum AS BIGINT) AS stratum, c0 AS start_ms, CAST(det AS BIGINT) AS detected_ms FROM rk WHERE rn = 1""")
def stratified_windows(spark, sf):
    """Eight equal time strata; in each the candidate window nearest its centre with enough speech.

    Candidates are 4 h windows on an hourly grid; only the ones a speech interval touches are
    generated, since the rest have no detected time.
    """
    hour, size = 3_600_000, 14_400_000
    speech = t.speech(spark, sf)
    record = speech.agg(F.min("s_ms").alias("lo"), F.max("e_ms").alias("hi")).select(
        F.expr(f"lo div {hour} * {hour}").alias("d0"), F.expr(f"(hi div {hour} + 1) * {hour}").alias("d1")
    )
    touched = speech.withColumn(
        "h", F.explode(F.expr(f"sequence((s_ms - {size}) div {hour} + 1, (e_ms - 1) div {hour})"))
    ).withColumn("c0", F.col("h") * hour)
    parts = touched.withColumn("part", F.least(F.col("c0") + size, "e_ms") - F.greatest("c0", "s_ms")).filter("part > 0")
    found = parts.groupBy("user_id", "c0").agg(F.sum("part").alias("det")).filter("det >= 1440000")
    placed = found.crossJoin(F.broadcast(record)).filter(f"c0 >= d0 AND c0 + {hour} <= d1")
    mid = f"(c0 + {size // 2} - d0)"
    strata = placed.withColumn("stratum", F.expr(f"{mid} * 8 div (d1 - d0)")).filter("stratum BETWEEN 0 AND 7")
    gap = F.expr(f"abs(16 * {mid} - (2 * stratum + 1) * (d1 - d0))")
    best = strata.groupBy("user_id", "stratum").agg(F.min(F.struct(gap.alias("g"), "c0", "det")).alias("b"))
    return best.select("user_id", "stratum", F.col("b.c0").alias("start_ms"), F.col("b.det").alias("detected_ms"))


@query("win12_proportional_units", "WITH " + t.CUE_SQL + r""",
parts AS (SELECT episode_id, cue_id, start_ms, end_ms, regexp_extract_all(replace(text, '.', '。'),
   '(?s)(?:[^\p{L}\p{N}]*[\p{L}\p{N}].*?(?:…*[。？！?!]+[」』）)”’]*|\z)(?:[^\p{L}\p{N}]+\z)?)|(?:.+)') AS p FROM cue),
u AS (SELECT episode_id, cue_id, start_ms, end_ms, unnest(p) AS unit, unnest(range(1, len(p) + 1)) AS pos FROM parts),
w AS (SELECT *, greatest(1, length(regexp_replace(unit, '[^\p{L}\p{N}]', '', 'g'))) AS wt FROM u),
c AS (SELECT *, sum(wt) OVER (PARTITION BY episode_id, cue_id ORDER BY pos) AS upto, sum(wt) OVER (PARTITION BY episode_id, cue_id) AS tot FROM w)
SELECT episode_id, cue_id, CAST(pos AS BIGINT) AS unit_no, unit, CAST(start_ms + (end_ms - start_ms) * (upto - wt) // tot AS BIGINT) AS unit_start,
  CAST(start_ms + (end_ms - start_ms) * upto // tot AS BIGINT) AS unit_end FROM c""")
def proportional_units(spark, sf):
    """Sentences of a cue share its time by lexical weight."""
    from cueloom.operators.layout import proportional_units as allot

    cues = t.cue(spark, sf).withColumn("text", F.replace("text", F.lit("."), F.lit("。")))
    return allot(cues, ["episode_id", "cue_id"], "text", "start_ms", "end_ms")
