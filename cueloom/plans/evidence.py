"""Evidence pools: unions, votes, consensus, star joins, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as tx, timecode as tc
from cueloom.operators import consensus, ordered, rules
from cueloom.plans.registry import query
from cueloom.shared import pin
from cueloom.sources import tables as t

_POOLS = """pools AS (SELECT episode_id, owner_id, observer, pool_ord, pos, sha256(text) AS text_sha, length(text) AS n_chars, 'pool' AS origin
  FROM observation WHERE status = 'ok' AND text <> ''
  UNION ALL SELECT lang, doc_id // 20, 'raw', -1, doc_id, sha256(text), length(text), 'first_pass' FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY doc_id // 20))"""


@query("src11_evidence_union", "WITH " + t.OBSERVATION_SQL + ", " + _POOLS + """
SELECT episode_id, owner_id, observer, pool_ord, pos, text_sha, CAST(n_chars AS BIGINT) AS n_chars, origin FROM pools""")
def evidence_union(spark, sf):
    """All pools in fixed order plus the first-pass transcript of each window; usable rows only."""
    from cueloom.sources.pools import evidence_pool

    pooled = evidence_pool(t.observation(spark, sf), t.table(spark, sf, "documents"))
    return pooled.select(
        "episode_id", "owner_id", "observer", "pool_ord", "pos", tx.digest(F.col("text")).alias("text_sha"),
        F.length("text").cast("bigint").alias("n_chars"), "origin",
    )


@query("set1_union_keeps_provenance", "WITH " + t.OBSERVATION_SQL + ", " + _POOLS + """
SELECT text_sha, count(*) AS n, count(DISTINCT observer) AS observers, count(DISTINCT owner_id) AS owners
FROM pools GROUP BY text_sha HAVING count(*) > 1""")
def union_keeps_provenance(spark, sf):
    """Equal texts from different observers stay separate rows in the union."""
    pooled = evidence_union(spark, sf)
    per = pooled.groupBy("text_sha", "observer", "owner_id").agg(F.count("*").alias("n"))
    return per.groupBy("text_sha").agg(
        F.sum("n").alias("n"), F.count_distinct("observer").alias("observers"),
        F.count_distinct("owner_id").alias("owners"),
    ).filter("n > 1")


_GRADE = r"""
k AS (SELECT *, lower(regexp_replace(w, '[\s,.:;!?()-]', '', 'g')) AS kw, lower(regexp_replace(n, '[\s,.:;!?()-]', '', 'g')) AS kn,
      lower(regexp_replace(q, '[\s,.:;!?()-]', '', 'g')) AS kq FROM vote),
graded AS (SELECT line, CASE WHEN n = '' OR q = '' THEN 'D'
   WHEN kw <> '' AND kw = kn AND kn = kq THEN CASE WHEN w = n AND n = q THEN 'A' ELSE 'A-音' END
   WHEN kn <> '' AND kn = kq THEN 'B+' WHEN kw <> '' AND kw = kn THEN 'B-' WHEN kw <> '' AND kw = kq THEN 'A-' ELSE 'C' END AS grade FROM k)"""


def _graded(spark, sf):
    v = t.vote(spark, sf)
    # Readings get their own projection: the grade looks at each several times.
    keyed = v.withColumns({f"k{c}": F.lower(F.translate(c, " \t\n\x0b\f\r,.:;!?()-", "")) for c in "wnq"})
    return keyed.select("line", consensus.grade_vote(*[F.col(c) for c in ("w", "n", "q", "kw", "kn", "kq")]).alias("grade"))


@query("agg1_vote_grade", "WITH " + t.VOTE_SQL + "," + _GRADE + " SELECT line, grade FROM graded")
def vote_grade(spark, sf):
    return _graded(spark, sf)


@query("agg1_grade_counts", "WITH " + t.VOTE_SQL + "," + _GRADE + " SELECT grade, count(*) AS lines FROM graded GROUP BY grade")
def grade_counts(spark, sf):
    return _graded(spark, sf).groupBy("grade").agg(F.count("*").alias("lines"))


_DICE = r"""
rd AS (SELECT owner_id, pos, text, regexp_matches(text, '[0-9]{3}') AS bad, lower(regexp_replace(text, '[^\p{L}\p{N}ー]', '', 'g')) AS c FROM observation WHERE status = 'ok'),
g AS (SELECT owner_id, pos, substr(c, i, 2) AS gram, count(*) AS n FROM rd, unnest(range(1, length(c))) AS x(i) GROUP BY 1, 2, 3),
sz AS (SELECT r.owner_id, r.pos, r.bad, greatest(length(c) - 1, 0) AS s, length(c) AS len FROM rd r),
sh AS (SELECT a.owner_id, a.pos AS pa, b.pos AS pb, sum(least(a.n, b.n)) AS m FROM g a JOIN g b ON a.owner_id = b.owner_id AND a.gram = b.gram AND a.pos <> b.pos GROUP BY 1, 2, 3),
sim AS (SELECT a.owner_id, a.pos AS pa, b.pos AS pb, coalesce(m, 0) AS m, CASE WHEN a.s > 0 AND b.s > 0 THEN 2000000 * coalesce(m, 0) // (a.s + b.s) ELSE 0 END AS d, a.s AS sa, a.len AS la, b.len AS lb, b.bad AS bad
  FROM sz a JOIN sz b ON a.owner_id = b.owner_id AND a.pos <> b.pos LEFT JOIN sh ON sh.owner_id = a.owner_id AND sh.pa = a.pos AND sh.pb = b.pos),
sc AS (SELECT s.owner_id, s.pos, s.len, coalesce((SELECT (7 * max(d) * count(*) + 3 * sum(d)) // (10 * count(*)) FROM sim WHERE sim.owner_id = s.owner_id AND pa = s.pos), 0) - CASE WHEN s.bad THEN 400000 ELSE 0 END AS score FROM sz s),
best AS (SELECT owner_id, arg_min(pos, -score * 100000000 + pos) AS pos, count(*) AS n FROM sc GROUP BY 1),
lng AS (SELECT b.owner_id, arg_min(x.pb, -x.lb * 100000000 + x.pb) AS pos FROM best b JOIN sim x ON x.owner_id = b.owner_id AND x.pa = b.pos
  WHERE NOT x.bad AND x.la * 10 < 8 * x.lb AND x.lb - x.la >= 12 AND x.la >= 2 AND x.m * 10 >= 8 * (x.la - 1) GROUP BY 1)"""


@query("agg2_consensus_choice", "WITH " + t.OBSERVATION_SQL + "," + _DICE + """
SELECT b.owner_id, coalesce(l.pos, b.pos) AS chosen, CAST(CASE WHEN l.pos IS NULL THEN greatest(0, s.score) ELSE least(600000, greatest(0, s.score)) END AS BIGINT) AS score,
  b.n AS n_readings, l.pos IS NOT NULL AS longer_kept
FROM best b LEFT JOIN lng l ON l.owner_id = b.owner_id JOIN sc s ON s.owner_id = b.owner_id AND s.pos = coalesce(l.pos, b.pos)""")
def consensus_choice(spark, sf):
    """Doubt is any run of three digits, a rule both engines can state."""
    usable = t.observation(spark, sf).filter("status = 'ok'")
    return consensus.choose_reading(usable, ["owner_id"], "pos", doubt=lambda c: c.rlike("[0-9]{3}"))


@query("agg2_consensus_repetition")
def consensus_repetition(spark, sf):
    """Doubt is the repetition and credit-line rule (back-references: Spark only)."""
    usable = t.observation(spark, sf).filter("status = 'ok'")
    return consensus.choose_reading(usable, ["owner_id"], "pos")


@query("agg3_support_grade")
def support_grade(spark, sf):
    """Support of each window's chosen reading; the choice joins back on the bounded window key."""
    usable = t.observation(spark, sf).filter("status = 'ok'").select("owner_id", "pos", "text")
    chosen = pin(consensus.choose_reading(usable, ["owner_id"], "pos").select("owner_id", "chosen"), "chosen")
    return consensus.support_grade(usable.join(chosen, "owner_id"), ["owner_id"], "pos", "chosen")


@query("agg4_first_occurrence", "WITH " + t.OBSERVATION_SQL + """
SELECT episode_id, sha256(text) AS text_sha, arg_min(pool_ord, pool_ord * 1000000000 + pos) AS pool_ord,
  arg_min(pos, pool_ord * 1000000000 + pos) AS pos, arg_min(observer, pool_ord * 1000000000 + pos) AS observer
FROM observation WHERE status = 'ok' AND text <> '' GROUP BY episode_id, text""")
def first_occurrence(spark, sf):
    """Per episode (here a language, a few huge keys) the first reading of each distinct text."""
    return consensus.first_occurrences(t.observation(spark, sf), ["episode_id"], ["pool_ord", "pos"], ["observer"])


@query("agg5_geometry_groups", "WITH " + t.OBSERVATION_SQL + """
SELECT owner_id, start_ms, end_ms, count(*) AS members, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(pos) AS BIGINT) AS pos_sum,
  greatest(0, least(end_ms, owner_id * 20000 + 20000) - greatest(start_ms, owner_id * 20000)) AS inside_owner_ms
FROM observation GROUP BY owner_id, start_ms, end_ms""")
def geometry_groups(spark, sf):
    obs = t.observation(spark, sf)
    return obs.groupBy("owner_id", "start_ms", "end_ms").agg(
        F.count("*").alias("members"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.sum("pos").alias("pos_sum"),
    ).withColumn(
        "inside_owner_ms",
        F.expr("greatest(0L, least(end_ms, owner_id * 20000 + 20000) - greatest(start_ms, owner_id * 20000))"),
    )


@query("agg6_duplicate_geometry", "WITH " + t.OBSERVATION_SQL + """
SELECT pos, owner_id, row_number() OVER (PARTITION BY owner_id, start_ms, end_ms ORDER BY pos) > 1 AS duplicate_geometry FROM observation""")
def duplicate_geometry(spark, sf):
    """A crop seen before in its window: compared with the first member, so no per-crop sort."""
    obs = t.observation(spark, sf).select("pos", "owner_id", "start_ms", "end_ms")
    firsts = obs.groupBy("owner_id", "start_ms", "end_ms").agg(F.min("pos").alias("_first"))
    return obs.join(firsts, ["owner_id", "start_ms", "end_ms"]).select(
        "pos", "owner_id", (F.col("pos") > F.col("_first")).alias("duplicate_geometry")
    )


@query("agg7_status_counts", "WITH " + t.OBSERVATION_SQL + """
SELECT coalesce(episode_id, '*') AS episode_id, coalesce(CAST(pool_ord AS VARCHAR), '*') AS pool, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status = 'unavailable') AS unavailable, bool_and(status <> 'unavailable') AS complete
FROM observation GROUP BY ROLLUP (episode_id, pool_ord)""")
def status_counts(spark, sf):
    obs = t.observation(spark, sf).withColumn("pool", F.col("pool_ord").cast("string"))
    return obs.rollup("episode_id", "pool").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        F.bool_and(F.col("status") != "unavailable").alias("complete"),
    ).withColumns({"episode_id": F.coalesce("episode_id", F.lit("*")), "pool": F.coalesce("pool", F.lit("*"))})


@query("agg10_window_document", "WITH " + t.OBSERVATION_SQL + """,
ln AS (SELECT owner_id, pool_ord, pos, '  reading ' || observer || ' [' || start_ms || '-' || end_ms || ']: ' || text AS line FROM observation WHERE status = 'ok' AND text <> '')
SELECT owner_id, sha256('## WINDOW ' || owner_id || chr(10) || string_agg(line, chr(10) ORDER BY pool_ord, pos)) AS doc_sha, count(*) AS readings,
  CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ln GROUP BY owner_id""")
def window_document(spark, sf):
    """Readings of each window as one ordered document (a window holds at most 20)."""
    line = F.format_string(
        "  reading %s [%d-%d]: %s", F.col("observer"), F.col("start_ms"), F.col("end_ms"), F.col("text")
    )
    lines = t.observation(spark, sf).filter("status = 'ok' AND text <> ''").select(
        "owner_id", F.struct("pool_ord", "pos", line.alias("line")).alias("row")
    )
    docs = lines.groupBy("owner_id").agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.count("*").alias("readings"),
        F.sum(F.length("row.line")).alias("n_chars"),
    )
    body = F.concat(F.lit("## WINDOW "), F.col("owner_id"), F.lit("\n"), F.array_join(F.col("rows.line"), "\n"))
    return docs.select("owner_id", F.sha2(body, 256).alias("doc_sha"), "readings", "n_chars")


@query("agg11_eligible_windows", "WITH " + t.OBSERVATION_SQL + """
SELECT DISTINCT owner_id, episode_id AS detected_language FROM observation
WHERE status = 'ok' AND text <> '' AND episode_id <> 'en' AND least(end_ms, owner_id * 20000 + 15000) > greatest(start_ms, owner_id * 20000 + 4000)""")
def eligible_windows(spark, sf):
    """Usable readings in another language that overlap detected speech."""
    speech = F.expr("least(end_ms, owner_id * 20000 + 15000) > greatest(start_ms, owner_id * 20000 + 4000)")
    obs = t.observation(spark, sf).filter("status = 'ok' AND text <> '' AND episode_id <> 'en'").filter(speech)
    return obs.select("owner_id", F.col("episode_id").alias("detected_language")).distinct()


@query("agg12_pool_identity", "WITH " + t.OBSERVATION_SQL + """
SELECT owner_id, sha256(string_agg(pos || ':' || sha256(text || '|' || status), ',' ORDER BY pos)) AS pool_version, count(*) AS receipts
FROM observation GROUP BY owner_id""")
def pool_identity(spark, sf):
    """Identity of each window's pool: hash over its ordered receipts (at most 20)."""
    receipt = F.concat_ws(":", F.col("pos"), F.sha2(F.concat_ws("|", "text", "status"), 256))
    rows = t.observation(spark, sf).select("owner_id", F.struct("pos", receipt.alias("r")).alias("x"))
    return rows.groupBy("owner_id").agg(
        F.sort_array(F.collect_list("x")).alias("xs"), F.count("*").alias("receipts")
    ).select("owner_id", F.sha2(F.array_join("xs.r", ","), 256).alias("pool_version"), "receipts")


@query("jn5_star_view", "WITH " + t.OBSERVATION_SQL + """,
obs_dim AS (SELECT observer, count(DISTINCT owner_id) AS owners_seen, min(pos) AS first_pos FROM observation GROUP BY 1),
view_dim AS (SELECT owner_id * 10 + pos % 10 AS view_id, count(DISTINCT start_ms) AS geometries, min(start_ms) AS v_start FROM observation GROUP BY 1)
SELECT o.pos, o.observer, d.owners_seen, d.first_pos, v.view_id, v.v_start, w.end_ms AS owner_end, v.geometries > 1 AS view_conflict
FROM observation o JOIN obs_dim d ON d.observer = o.observer JOIN view_dim v ON v.view_id = o.owner_id * 10 + o.pos % 10
JOIN (SELECT DISTINCT owner_id, owner_id * 20000 + 20000 AS end_ms FROM observation) w ON w.owner_id = o.owner_id""")
def star_view(spark, sf):
    """Observation with its observer, view and owner; a view seen with two geometries is a conflict."""
    obs = t.observation(spark, sf).drop("text", "status").withColumn("view_id", F.expr("owner_id * 10 + pos % 10"))
    seen = obs.groupBy("observer", "owner_id").agg(F.min("pos").alias("p"))
    observer = seen.groupBy("observer").agg(F.count("*").alias("owners_seen"), F.min("p").alias("first_pos"))
    view = obs.groupBy("view_id").agg(
        F.count_distinct("start_ms").alias("geometries"), F.min("start_ms").alias("v_start")
    )
    owner = t.owner(spark, sf).select("owner_id", F.col("end_ms").alias("owner_end"))
    joined = obs.join(observer, "observer").join(view, "view_id").join(owner, "owner_id")
    return joined.select(
        "pos", "observer", "owners_seen", "first_pos", "view_id", "v_start", "owner_end",
        (F.col("geometries") > 1).alias("view_conflict"),
    )


@query("jn6_evidence_defaults", "WITH " + t.CUE_SQL + ", " + t.VOTE_SQL + "," + _GRADE + """,
arb AS (SELECT v.line, g.grade, CASE WHEN v.line % 6 = 0 THEN v.w || '!' ELSE v.w END AS w FROM vote v JOIN graded g ON g.line = v.line),
scr AS (SELECT item_id, text FROM benchmark)
SELECT c.episode_id, c.cue_id, coalesce(a.grade, 'not_checked') AS grade, coalesce(length(s.text), 0) > 0 AS has_script,
  a.w IS NOT NULL AND a.w <> d.text AS stale, coalesce(q.title, '') AS title_note
FROM cue c LEFT JOIN arb a ON a.line = c.episode_id * 8 + c.cue_id LEFT JOIN documents d ON d.doc_id = a.line
LEFT JOIN scr s ON s.item_id = c.episode_id LEFT JOIN (SELECT page_id, 'page' AS title FROM pages) q ON q.page_id = c.episode_id * 2 + c.cue_id""")
def evidence_defaults(spark, sf):
    """Cue with arbitration, script and title evidence; defaults where there is none."""
    cues = t.cue(spark, sf).select(
        "episode_id", "cue_id", F.expr("episode_id * 8 + cue_id").alias("line"),
        F.expr("episode_id * 2 + cue_id").alias("page_id"),
    )
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("line"), "text")
    votes = t.vote(spark, sf)
    arbitration = votes.join(_graded(spark, sf), "line").select(
        "line", "grade", F.when(F.col("line") % 6 == 0, F.concat("w", F.lit("!"))).otherwise(F.col("w")).alias("w")
    )
    script = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("episode_id"), F.col("text").alias("script"))
    title = t.table(spark, sf, "pages").select("page_id", F.lit("page").alias("title_note"))
    joined = (
        cues.join(arbitration, "line", "left").join(docs, "line", "left")
        .join(script, "episode_id", "left").join(title, "page_id", "left")
    )
    return joined.select(
        "episode_id", "cue_id", F.coalesce("grade", F.lit("not_checked")).alias("grade"),
        (F.coalesce(F.length("script"), F.lit(0)) > 0).alias("has_script"),
        F.coalesce(F.col("w") != F.col("text"), F.lit(False)).alias("stale"),
        F.coalesce("title_note", F.lit("")).alias("title_note"),
    )


@query("val4_unique_keys", "WITH " + t.OBSERVATION_SQL + """
SELECT episode_id, observer, sha256(text) AS text_sha, count(*) AS n FROM observation WHERE text <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def unique_keys(spark, sf):
    keyed = t.observation(spark, sf).filter("text <> ''").withColumn("text_sha", F.sha2("text", 256))
    return rules.repeated_keys(keyed, ["episode_id", "observer", "text_sha"])


@query("val5_observer_coverage", "WITH " + t.OBSERVATION_SQL + """,
u AS (SELECT * FROM observation WHERE status = 'ok'),
own AS (SELECT item_id * 2 AS owner_id FROM benchmark)
SELECT owner_id, 'unobserved_owner' AS rule, 0 AS detail FROM own WHERE owner_id NOT IN (SELECT owner_id FROM u)
UNION ALL SELECT DISTINCT owner_id, 'unknown_owner', 0 FROM u WHERE owner_id NOT IN (SELECT owner_id FROM own)
UNION ALL SELECT owner_id, 'observer_count', count(DISTINCT observer) FROM u GROUP BY owner_id HAVING count(DISTINCT observer) <> 18""")
def observer_coverage(spark, sf):
    """Every scheduled owner (benchmark items) observed, no other one, the scheduled number of observers each."""
    obs = t.observation(spark, sf).select("owner_id", "observer", "status")
    used = obs.filter("status = 'ok'")
    owners = t.table(spark, sf, "benchmark").select((F.col("item_id") * 2).alias("owner_id"))
    sides = rules.one_sided(owners, used, ["owner_id"], "unobserved_owner", "unknown_owner")
    counts = used.distinct().groupBy("owner_id").agg(F.count("*").alias("detail")).filter("detail <> 18")
    return sides.withColumn("detail", F.lit(0).cast("bigint")).unionByName(
        counts.select("owner_id", F.lit("observer_count").alias("rule"), "detail")
    )


@query("val9_status_text", r"""SELECT rule, count(*) AS n FROM (
SELECT CASE WHEN st = 'ok' AND trim(txt) = '' THEN 'ok_without_text' WHEN st = 'empty' AND trim(txt) <> '' THEN 'empty_with_text'
  WHEN st = 'unavailable' AND txt <> '' THEN 'unavailable_with_text' WHEN st NOT IN ('ok', 'empty', 'unavailable') THEN 'unknown_status' ELSE 'consistent' END AS rule
FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'lost' ELSE 'ok' END AS st,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS txt FROM documents)) GROUP BY rule""")
def status_text(spark, sf):
    from cueloom.functions.contracts import status_rule

    d = F.col("doc_id") % 7
    rows = t.table(spark, sf, "documents").select(
        F.when(d == 0, "empty").when(d == 1, "unavailable").when(d == 2, "lost").otherwise("ok").alias("status"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"),
    )
    return rows.groupBy(status_rule(F.col("status"), F.col("text")).alias("rule")).agg(F.count("*").alias("n"))


@query("top3_exact_order", "WITH " + t.OBSERVATION_SQL + """
SELECT pos, row_number() OVER (ORDER BY start_ms * 16, end_ms * 16, owner_id, pos) AS position FROM observation""")
def exact_order(spark, sf):
    """Total order on exact start, end, owner and id, as positions; no single-task sort."""
    obs = t.observation(spark, sf).select(
        "pos", "owner_id", tc.frames(F.col("start_ms")).alias("s"), tc.frames(F.col("end_ms")).alias("e")
    )
    return ordered.dense_rank_positions(obs, [], ["s", "e", "owner_id", "pos"], "position").select("pos", "position")


@query("top4_length_batches", """WITH r AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS k FROM documents)
SELECT k // 8 AS batch, count(*) AS members, CAST(min(n) AS BIGINT) AS shortest, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY 1""")
def length_batches(spark, sf):
    """Batches of eight similar lengths."""
    rows = t.table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    placed = ordered.dense_rank_positions(rows, [], ["n", "doc_id"], "k")
    return placed.groupBy(F.expr("(k - 1) div 8").alias("batch")).agg(
        F.count("*").alias("members"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    )


@query("win16_chunks", "WITH " + t.CUE_SQL + """
SELECT episode_id, cue_id, (cue_id - 1) // 3 AS chunk, (cue_id - 1) % 3 + 1 AS local_id FROM cue""")
def chunks(spark, sf):
    """Runs of three cues; ids are dense, so position needs no sort."""
    return t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), (F.col("turn") + 1).alias("cue_id"),
        F.expr("turn div 3").alias("chunk"), F.expr("turn % 3 + 1").alias("local_id"),
    )


@query("win17_stable_aliases", "WITH " + t.OBSERVATION_SQL + """,
f AS (SELECT observer, min(owner_id * 1000000 + pool_ord * 100000 + pos % 20) AS first_use FROM observation GROUP BY 1)
SELECT observer, printf('R%03d', row_number() OVER (ORDER BY first_use, observer)) AS alias, first_use FROM f""")
def stable_aliases(spark, sf):
    """Observers named R001.. in order of first use."""
    use = F.expr("owner_id * 1000000 + pool_ord * 100000 + pos % 20")
    firsts = t.observation(spark, sf).groupBy("observer").agg(F.min(use).alias("first_use"))
    placed = ordered.dense_rank_positions(firsts, [], ["first_use", "observer"], "k")
    return placed.select("observer", F.format_string("R%03d", "k").alias("alias"), "first_use")


@query("win19_uniform_sample", "WITH " + t.OWNER_SQL + """,
n AS (SELECT count(*) AS n, (count(*) * 42 + 66) // 132 AS m FROM owner),
pick AS (SELECT DISTINCT 1 + (2 * i * (n - 1) + (m - 1)) // (2 * (m - 1)) AS k FROM n, unnest(range(0, m)) AS g(i)),
r AS (SELECT owner_id, row_number() OVER (ORDER BY owner_id) AS k FROM owner)
SELECT owner_id, r.k FROM r JOIN pick p ON p.k = r.k""")
def uniform_sample(spark, sf):
    """Evenly spaced windows over the whole time line: round(21/66 of them)."""
    owners = t.owner(spark, sf).select("owner_id")
    placed = ordered.dense_rank_positions(owners, [], ["owner_id"], "k")
    size = owners.agg(F.count("*").alias("n")).withColumn("m", F.expr("(n * 42 + 66) div 132"))
    picks = size.select("n", "m", F.explode(F.expr("sequence(0L, m - 1)")).alias("i"))
    wanted = picks.select(F.expr("1 + (2 * i * (n - 1) + (m - 1)) div (2 * (m - 1))").alias("k")).distinct()
    return placed.join(wanted, "k").select("owner_id", "k")
