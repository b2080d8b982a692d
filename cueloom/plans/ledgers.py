"""Edit transactions, ledgers, caches, gates and selection queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F


from cueloom.operators import dictionary, ledger, ordered, segments
from cueloom.plans import evidence, geometry, matching
from cueloom.plans.registry import query
from cueloom.shared import pin
from cueloom.sources import tables as t

_PREP = """,
prep AS (SELECT *, CASE WHEN base_hash <> sha256(target) THEN 'stale_base' WHEN old = '' THEN 'empty_span'
  WHEN len(list_filter(range(1, length(target) + 1), lambda i: substr(target, i, length(old)) = old)) <> 1 THEN 'target_span_not_unique'
  WHEN length(old) > 160 THEN 'target_span_over_160_codepoints' WHEN length(target) > 100 AND length(old) * 5 > length(target) * 3 THEN 'target_span_over_60_percent'
  WHEN length(new) > greatest(64, 2 * length(old)) THEN 'replacement_too_long' END AS rejection FROM edit),
tx AS (SELECT *, rejection IS NULL AS valid, CASE WHEN rejection IS NULL THEN replace(target, old, new) ELSE target END AS after FROM prep)"""


def _tx(spark, sf):
    return ledger.prepare(t.edit(spark, sf))


@query("led1_prepare_patch", "WITH " + t.EDIT_SQL + _PREP + " SELECT episode_id, cue_id, valid, coalesce(rejection, '') AS rejection, sha256(after) AS after_sha FROM tx")
def prepare_patch(spark, sf):
    return _tx(spark, sf).select(
        "episode_id", "cue_id", "valid", F.coalesce("rejection", F.lit("")).alias("rejection"), F.sha2("after", 256).alias("after_sha")
    )


@query("led2_apply_batch", "WITH " + t.EDIT_SQL + _PREP + """,
bad AS (SELECT DISTINCT episode_id FROM tx WHERE NOT valid)
SELECT p.episode_id, p.cue_id, x.after IS NOT NULL AS applied, sha256(coalesce(x.after, p.target)) AS sha FROM pair p LEFT JOIN (SELECT * FROM tx WHERE episode_id NOT IN (SELECT episode_id FROM bad)) x
ON x.episode_id = p.episode_id AND x.cue_id = p.cue_id""")
def apply_batch(spark, sf):
    done = ledger.apply_batch(t.pair(spark, sf), _tx(spark, sf), ["episode_id"], ["cue_id"], "target")
    return done.select("episode_id", "cue_id", "applied", F.sha2("target", 256).alias("sha"))


@query("led4_rollback", "WITH " + t.EDIT_SQL + _PREP + """,
kept AS (SELECT * FROM tx WHERE valid AND length(old) >= 4)
SELECT p.episode_id, p.cue_id, x.after IS NOT NULL AS applied, sha256(coalesce(x.after, p.target)) AS sha FROM pair p LEFT JOIN kept x ON x.episode_id = p.episode_id AND x.cue_id = p.cue_id""")
def rollback(spark, sf):
    """Regressed transactions are taken out and the rest re-applied to the original base."""
    txs = _tx(spark, sf).filter("valid")
    regressed = txs.filter("length(old) < 4").select("episode_id", "cue_id")
    kept = txs.join(regressed, ["episode_id", "cue_id"], "left_anti")
    done = ledger.apply_batch(t.pair(spark, sf), kept, ["episode_id"], ["cue_id"], "target")
    return done.select("episode_id", "cue_id", "applied", F.sha2("target", 256).alias("sha"))


@query("led3_ordered_edits")
def ordered_edits(spark, sf):
    """Three edits per target, each judged against the text the ones before it left."""
    words = F.split("target", r"\s+")
    edit = lambda o, n: F.struct(o.alias("old"), n.alias("new"))
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    edits = F.array(edit(first, F.concat(F.upper(first), F.lit("-"))), edit(first, F.lit("x")), edit(last, F.lit("end")))
    rows = t.pair(spark, sf).select("episode_id", "cue_id", ledger.apply_in_order(F.col("target"), edits).alias("r"))
    return rows.select("episode_id", "cue_id", "r.applied", "r.refused", F.sha2("r.text", 256).alias("sha"))


@query("led5_group_commit", "WITH " + t.EDIT_SQL + """,
f AS (SELECT episode_id, cue_id, CASE WHEN cue_id - lag(cue_id) OVER w <= 2 THEN 0 ELSE 1 END AS o FROM edit WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id)),
c AS (SELECT episode_id, cue_id, sum(o) OVER (PARTITION BY episode_id ORDER BY cue_id) AS comp FROM f)
SELECT episode_id, cue_id, bool_and((episode_id + cue_id) % 6 <> 0) OVER (PARTITION BY episode_id, comp) AS committed FROM c""")
def group_commit(spark, sf):
    """A component commits only when every member passed every check."""
    ids = ordered.dense_blocks(t.edit(spark, sf).select("episode_id", "cue_id"), "cue_id")
    comps = segments.components(ids, ["episode_id"], "cue_id", 1)
    checked = comps.withColumn("ok", F.expr("(episode_id + cue_id) % 6 <> 0"))
    verdict = checked.groupBy("episode_id", "component").agg(F.bool_and("ok").alias("committed"))
    return checked.join(verdict, ["episode_id", "component"]).select("episode_id", "cue_id", "committed")


@query("led6_neighbour_commit", "WITH " + t.CUE_SQL + """
SELECT episode_id, cue_id, bool_and((episode_id * 3 + cue_id) % 5 <> 0) OVER (PARTITION BY episode_id ORDER BY cue_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS kept FROM cue""")
def neighbour_commit(spark, sf):
    rows = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), (F.col("turn") + 1).alias("cue_id")
    ).withColumn("ok", F.expr("(episode_id * 3 + cue_id) % 5 <> 0"))
    around = ledger.neighbours_ok(rows, ["episode_id"], "cue_id", "ok")
    return rows.join(around, ["episode_id", "cue_id"]).select("episode_id", "cue_id", F.col("around_ok").alias("kept"))


_STATUS = """,
led AS (SELECT line, CASE grade WHEN 'D' THEN 'unchecked' WHEN 'C' THEN 'unresolved' WHEN 'B+' THEN 'corrected' ELSE 'accepted' END AS source_status,
  CASE line % 5 WHEN 0 THEN 'corrected' WHEN 1 THEN 'unchecked' WHEN 2 THEN 'unresolved' ELSE 'accepted' END AS target_status FROM graded),
fin AS (SELECT *, CASE WHEN source_status IN ('unresolved', 'unchecked') AND target_status <> 'unchecked' THEN source_status ELSE target_status END AS status FROM led)"""


def _ledger(spark, sf):
    graded = evidence.vote_grade(spark, sf)
    source = F.expr("CASE grade WHEN 'D' THEN 'unchecked' WHEN 'C' THEN 'unresolved' WHEN 'B+' THEN 'corrected' ELSE 'accepted' END")
    target = F.expr("CASE line % 5 WHEN 0 THEN 'corrected' WHEN 1 THEN 'unchecked' WHEN 2 THEN 'unresolved' ELSE 'accepted' END")
    rows = graded.select("line", source.alias("source_status"), target.alias("target_status"))
    return rows.withColumn("status", ledger.final_status(F.col("source_status"), F.col("target_status")))


@query("led7_status_precedence", "WITH " + t.VOTE_SQL + "," + evidence._GRADE + _STATUS + " SELECT * FROM fin")
def status_precedence(spark, sf):
    return _ledger(spark, sf)


@query("src13_quality_report", "WITH " + t.VOTE_SQL + "," + evidence._GRADE + _STATUS + """
SELECT 'count' AS section, status AS item, count(*) AS n FROM fin GROUP BY status UNION ALL SELECT 'complete', CAST(bool_and(status <> 'unchecked') AS VARCHAR), count(*) FROM fin
UNION ALL SELECT 'open', CAST(line AS VARCHAR) || ' ' || status, 1 FROM fin WHERE status <> 'accepted' OR source_status = 'corrected'""")
def quality_report(spark, sf):
    """Counts, completeness and every line that is not plainly accepted."""
    rows = pin(_ledger(spark, sf), "ledger")  # three branches read it
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    done = counts.agg(F.bool_and(F.col("status") != "unchecked").cast("string").alias("item"), F.sum("n").alias("n"))
    open_rows = rows.filter("status <> 'accepted' OR source_status = 'corrected'")
    return (
        counts.select(F.lit("count").alias("section"), F.col("status").alias("item"), "n")
        .unionByName(done.select(F.lit("complete").alias("section"), "item", "n"))
        .unionByName(open_rows.select(F.lit("open").alias("section"), F.concat_ws(" ", "line", "status").alias("item"), F.lit(1).cast("bigint").alias("n")))
    )


@query("led8_fallback", """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'answer' WHEN l.doc_id IS NOT NULL THEN 'retain_all' ELSE 'draft' END AS used, coalesce(l.quality, 0) <> 1 AS fallback_used,
  sha256(CASE WHEN l.quality = 1 THEN upper(d.source) ELSE d.source END) AS sha FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def fallback(spark, sf):
    rows = t.table(spark, sf, "documents").select("doc_id", "source").join(
        t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select(
        "doc_id", F.when(good, "answer").when(F.col("quality").isNotNull(), "retain_all").otherwise("draft").alias("used"),
        (~good).alias("fallback_used"), F.sha2(F.when(good, F.upper("source")).otherwise(F.col("source")), 256).alias("sha"),
    )


@query("led9_name_masks", "WITH " + t.ALIAS_SQL + r""",
nm AS (SELECT surface, min(entity_id) AS entity FROM alias GROUP BY 1 HAVING count(*) = 1),
p AS (SELECT doc_id, unnest(ps) AS part, unnest(range(0, len(ps))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?s)\p{L}+|[^\p{L}]+') AS ps FROM documents))
SELECT doc_id, sha256(string_agg(CASE WHEN entity IS NULL THEN part ELSE '⟦E' || printf('%04d', k) || '⟧' END, '' ORDER BY k)) AS sha, count(entity) AS markers, true AS lossless
FROM p LEFT JOIN nm ON nm.surface = lower(part) GROUP BY doc_id""")
def name_masks(spark, sf):
    names = t.alias_words(spark, sf).groupBy("surface").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity")).filter("n = 1").drop("n")
    cut = dictionary.marked(t.table(spark, sf, "documents"), "text", names, ["doc_id"])
    back = dictionary.restored()(F.col("cut.marked"), F.col("cut.markers"), F.col("cut.surfaces"))
    return cut.withColumn("back", back).select(
        "doc_id", F.sha2("cut.marked", 256).alias("sha"), F.col("back.markers").alias("markers"),
        (F.col("back.exact") & (F.col("back.restored") == F.col("text"))).alias("lossless"),
    )


@query("led10_column_split", "SELECT doc_id, sha256(text || '|' || lang || '|' || source || '|' || n_chars) AS sha, true AS same FROM documents")
def column_split(spark, sf):
    """Operational columns moved to a sidecar and joined back by row id."""
    whole = F.sha2(F.concat_ws("|", "text", "lang", "source", "n_chars"), 256)
    docs = t.table(spark, sf, "documents").withColumn("sha", whole)
    body, sidecar = docs.select("doc_id", "text", "lang", "sha"), docs.select("doc_id", "source", "n_chars")
    return body.join(sidecar, "doc_id").select("doc_id", "sha", (whole == F.col("sha")).alias("same"))


@query("led11_issue_lifecycle", "WITH " + t.TELEMETRY_SQL + """
SELECT user_id AS issue_id, arg_max(stage, at_ms * 1000000 + event_id % 1000000) AS state, count(*) AS steps, count(*) FILTER (stage = 'error') AS attempts, CAST(max(at_ms) - min(at_ms) AS BIGINT) AS open_ms FROM telemetry GROUP BY 1""")
def issue_lifecycle(spark, sf):
    """State of each issue from its append-only log."""
    return t.telemetry(spark, sf).groupBy(F.col("user_id").alias("issue_id")).agg(
        F.max_by("stage", F.struct("at_ms", F.expr("event_id % 1000000"))).alias("state"), F.count("*").alias("steps"),
        F.count_if(F.col("stage") == "error").alias("attempts"), (F.max("at_ms") - F.min("at_ms")).alias("open_ms"),
    )


_EVENT = """CASE stage WHEN 'error' THEN 'issue' WHEN 'purchase' THEN 'repair' WHEN 'signup' THEN 'repair'
  WHEN 'click' THEN CASE attempt % 3 WHEN 0 THEN 'persists' WHEN 1 THEN 'resolved' ELSE 'unsupported' END ELSE 'seen' END"""


@query("led11_issue_cycles", "WITH RECURSIVE " + t.TELEMETRY_SQL + f""",
q AS (SELECT user_id, event_id, {_EVENT} AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM telemetry WHERE attempt IS NOT NULL),
st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS k, 'not_flagged' AS s, 0 AS n, 0 AS ch FROM q
 UNION ALL SELECT user_id, event_id, k, nx, CASE WHEN s = 'persists' AND ev = 'repair' AND n < 2 THEN n + 1 ELSE n END, CAST(nx <> s AS INT) FROM (
  SELECT q.*, st.s, st.n, CASE
    WHEN st.s = 'not_flagged' AND ev = 'issue' THEN 'diagnosed'
    WHEN st.s = 'persists' AND ev = 'repair' AND st.n < 2 THEN 'repaired'
    WHEN st.s = 'repaired' AND ev = 'resolved' THEN 'resolved'
    WHEN st.s IN ('diagnosed', 'unsupported', 'repaired', 'resolved') AND ev = 'persists' THEN 'persists'
    WHEN st.s IN ('diagnosed', 'persists', 'repaired', 'resolved') AND ev = 'unsupported' THEN 'unsupported'
    ELSE st.s END AS nx FROM st JOIN q ON q.user_id = st.user_id AND q.k = st.k + 1))
SELECT user_id AS issue_id, arg_max(s, k) AS status, arg_max(s, k) = 'persists' AS unresolved, CAST(max(n) AS BIGINT) AS repair_attempts,
  CAST(sum(ch) AS BIGINT) AS changes, count(*) FILTER (ch = 1 AND s = 'resolved') AS times_resolved,
  coalesce(string_agg(CASE WHEN ch = 1 THEN s END, '>' ORDER BY k), '') AS history
FROM st WHERE k > 0 GROUP BY 1""")
def issue_cycles(spark, sf):
    """Diagnosis, precheck and repair cycles of each issue, with its history of states."""
    log = t.telemetry(spark, sf).filter("attempt IS NOT NULL").select("user_id", "event_id", F.expr(_EVENT).alias("ev"))
    states = ledger.issue_states(ordered.key_blocks(log, ["user_id"], "event_id"), ["user_id"], ["event_id"], "ev")
    final = F.max_by("state", "event_id")
    # A history has the changes only: a state is left at most as often as repairs and rechecks allow it to be entered.
    path = F.array_sort(F.collect_list(F.when(F.col("changed") == 1, F.struct("event_id", "state"))))
    return states.groupBy(F.col("user_id").alias("issue_id")).agg(
        final.alias("status"), (final == "persists").alias("unresolved"), F.max("attempts").alias("repair_attempts"),
        F.sum("changed").alias("changes"), F.count_if((F.col("changed") == 1) & (F.col("state") == "resolved")).alias("times_resolved"),
        F.array_join(path["state"], ">").alias("history"),
    )


@query("led12_result_cache", """WITH c AS (SELECT sha256(text) AS k, min(l.doc_id * 2 + toxic) // 2 AS d, min(l.doc_id * 2 + toxic) % 2 AS bad FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT doc_id, CASE WHEN d IS NULL THEN 'miss' WHEN bad = 1 THEN 'tampered' ELSE 'hit' END AS state FROM documents LEFT JOIN c ON k = sha256(text)""")
def result_cache(spark, sf):
    """Requests answered from a cache (labelled documents) by fingerprint; an answer that fails its own hash is refused."""
    docs = t.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    answer = F.concat(F.lit("answer "), F.col("e.doc_id"))
    entries = docs.join(t.table(spark, sf, "labels"), "doc_id").groupBy("k").agg(F.min(F.struct("doc_id", "toxic")).alias("e"))
    cache = entries.select(
        "k", answer.alias("answer"), F.sha2(F.when(F.col("e.toxic") == 1, F.concat(answer, F.lit("!"))).otherwise(answer), 256).alias("pinned")
    )
    return docs.join(cache, "k", "left").select(
        "doc_id", F.when(F.col("answer").isNull(), "miss").when(F.sha2("answer", 256) != F.col("pinned"), "tampered").otherwise("hit").alias("state")
    )


@query("led13_stage_manifest", "SELECT source AS stage, count(*) AS outputs, bool_and(NOT (source IN ('src3', 'src7') AND doc_id % 40 < 10)) AS reusable FROM documents GROUP BY 1")
def stage_manifest(spark, sf):
    """A stage is reusable when every output still has the hash its manifest records."""
    docs = t.table(spark, sf, "documents")
    stale = F.expr("source IN ('src3', 'src7') AND doc_id % 40 < 10")
    manifest = docs.select("doc_id", F.sha2(F.when(stale, F.lit("old")).otherwise(F.col("text")), 256).alias("pinned"))
    now = docs.select("doc_id", F.col("source").alias("stage"), F.sha2("text", 256).alias("sha"))
    return now.join(manifest, "doc_id", "left").groupBy("stage").agg(
        F.count("*").alias("outputs"), F.bool_and(F.col("sha").eqNullSafe(F.col("pinned"))).alias("reusable")
    )


@query("led14_first_snapshot", "WITH " + t.TELEMETRY_SQL + " SELECT user_id, stage, min(event_id) AS snapshot, arg_min(millis, event_id) AS millis FROM telemetry GROUP BY 1, 2")
def first_snapshot(spark, sf):
    return t.telemetry(spark, sf).groupBy("user_id", "stage").agg(
        F.min("event_id").alias("snapshot"), F.min_by("millis", "event_id").alias("millis")
    )


@query("led15_release_gate", "WITH " + t.CUE_SQL + ", " + geometry._SHIFTED + """,
s AS (SELECT *, lag(end_ms, 1, 0) OVER (PARTITION BY episode_id ORDER BY cue_id) AS prev FROM shifted),
f AS (SELECT episode_id, cue_id, 'nonpositive' AS kind FROM s WHERE end_ms <= start_ms UNION ALL SELECT episode_id, cue_id, 'overlap' FROM s WHERE start_ms < prev
  UNION ALL SELECT episode_id, cue_id, 'short-cue' FROM s WHERE end_ms - start_ms < 400 UNION ALL SELECT episode_id, cue_id, 'long-cue' FROM s WHERE end_ms - start_ms > 10000),
o AS (SELECT * FROM f WHERE kind <> 'long-cue')
SELECT e.episode_id, count(o.kind) AS open_findings, count(o.kind) = 0 AS passes FROM (SELECT DISTINCT episode_id FROM cue) e LEFT JOIN o ON o.episode_id = e.episode_id GROUP BY 1""")
def release_gate(spark, sf):
    """Findings less waivers (here every long cue); structure findings cannot be waived."""
    found = geometry.display_lint(spark, sf)
    episodes = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("episode_id")).distinct()
    waivers = found.filter("kind = 'long-cue'")
    left = found.join(waivers.select("episode_id", "cue_id", "kind").distinct(), ["episode_id", "cue_id", "kind"], "left_anti")
    per = left.groupBy("episode_id").agg(F.count("*").alias("open_findings"))
    return episodes.join(per, "episode_id", "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0)).cast("bigint")).withColumn(
        "passes", F.col("open_findings") == 0
    )


@query("led16_source_decision", "WITH " + t.VOTE_SQL + "," + evidence._GRADE + """
SELECT v.line, grade, CASE WHEN grade IN ('C', 'D') THEN 'blocked' WHEN grade IN ('A', 'A-') THEN 'keep' WHEN v.line % 4 = 0 THEN 'unsure' WHEN v.line % 2 = 1 THEN 'select' ELSE 'keep' END AS decision,
  sha256(CASE WHEN grade NOT IN ('A', 'A-', 'C', 'D') AND v.line % 4 <> 0 AND v.line % 2 = 1 THEN v.q ELSE v.w END) AS sha FROM vote v JOIN graded g ON g.line = v.line""")
def source_decision(spark, sf):
    rows = t.vote(spark, sf).join(evidence.vote_grade(spark, sf), "line")
    decision = F.expr("""CASE WHEN grade IN ('C', 'D') THEN 'blocked' WHEN grade IN ('A', 'A-') THEN 'keep' WHEN line % 4 = 0 THEN 'unsure'
        WHEN line % 2 = 1 THEN 'select' ELSE 'keep' END""")
    candidates = F.create_map(F.lit("W"), F.col("w"), F.lit("N"), F.col("n"), F.lit("Q"), F.col("q"))
    chosen = F.when(F.col("decision") == "select", candidates["Q"]).otherwise(candidates["W"])
    return rows.withColumn("decision", decision).select("line", "grade", "decision", F.sha2(chosen, 256).alias("sha"))


@query("led17_last_complete", "WITH " + t.TELEMETRY_SQL + """
SELECT user_id, stage, coalesce(max(attempt) FILTER (millis % 2 = 0), -1) AS complete_attempt, count(*) FILTER (millis % 2 = 1) AS set_aside FROM telemetry GROUP BY 1, 2""")
def last_complete(spark, sf):
    """Interrupted attempts are counted and set aside; the newest complete one is current."""
    done = F.col("millis") % 2 == 0
    return t.telemetry(spark, sf).groupBy("user_id", "stage").agg(
        F.coalesce(F.max(F.when(done, F.col("attempt"))), F.lit(-1)).cast("bigint").alias("complete_attempt"), F.count_if(~done).alias("set_aside")
    )


@query("agg14_budget", "WITH " + t.TELEMETRY_SQL + """,
r AS (SELECT event_id, stage, millis, sum(millis) OVER (PARTITION BY stage ORDER BY at_ms, event_id) AS used FROM telemetry)
SELECT event_id, stage, CAST(used AS BIGINT) AS used_ms, used > 20000000 AS over_budget FROM r""")
def budget(spark, sf):
    """Running time per stage against its budget (five stages, so each is a hot key)."""
    cut = ordered.range_blocks(t.telemetry(spark, sf).select("event_id", "stage", "millis", "at_ms"), ["stage"], ["at_ms", "event_id"])
    run = ordered.scan(cut, ["stage"], ["at_ms", "event_id"], before={"b": F.col("millis")})
    return run.withColumn("used_ms", F.col("b") + F.col("millis")).select("event_id", "stage", "used_ms", (F.col("used_ms") > 20000000).alias("over_budget"))


@query("agg15_review_scores", "WITH " + t.REVIEW_SQL + """
SELECT candidate, coalesce(max(overall) FILTER (role = 'primary'), -1) AS primary_score, coalesce(max(overall) FILTER (role = 'confirmation'), -1) AS confirmation_score,
  arg_max(overall, started) AS latest, count(*) = 2 AND min(overall) >= 4 AND max(overall) - min(overall) <= 1 AS confirmed FROM review GROUP BY 1""")
def review_scores(spark, sf):
    role = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("overall"))), F.lit(-1)).cast("bigint")
    return t.review(spark, sf).groupBy("candidate").agg(
        role("primary").alias("primary_score"), role("confirmation").alias("confirmation_score"),
        F.max_by("overall", "started").alias("latest"),
        ((F.count("*") == 2) & (F.min("overall") >= 4) & (F.max("overall") - F.min("overall") <= 1)).alias("confirmed"),
    )


@query("agg16_decision_acceptance", "WITH " + t.OBSERVATION_SQL + """,
v AS (SELECT owner_id, pos FROM observation WHERE status = 'ok'), c AS (SELECT owner_id, pos, pos % 3 AS a, pos % 4 AS b FROM observation WHERE status = 'ok' AND length(text) >= 60 UNION ALL SELECT owner_id, pos, 0, 1 FROM observation WHERE length(text) > 9000 AND status = 'ok'),
j AS (SELECT coalesce(v.owner_id, c.owner_id) AS owner_id, v.pos AS vp, c.pos AS cp, a, b FROM v FULL JOIN c ON v.owner_id = c.owner_id AND v.pos = c.pos)
SELECT owner_id, count(*) FILTER (cp IS NULL) AS unchecked, count(cp) - count(DISTINCT cp) AS repeated,
  count(*) FILTER (cp IS NULL) = 0 AND count(cp) = count(DISTINCT cp) AND bool_or(coalesce(a = 0, false)) AND bool_and(coalesce(NOT (b = 0 AND a = 1), true)) AS accepted FROM j GROUP BY 1""")
def decision_acceptance(spark, sf):
    """Every viable reading checked once, one supportive, none weakened (0 = supported, 1 = uncertain)."""
    viable = t.observation(spark, sf).filter("status = 'ok'").select("owner_id", "pos", F.length("text").alias("n_text"))
    checks = viable.filter("n_text >= 60").select("owner_id", "pos", F.expr("pos % 3").alias("after"), F.expr("pos % 4").alias("before")).unionByName(
        viable.filter("n_text > 9000").select("owner_id", "pos", F.lit(0).cast("bigint").alias("after"), F.lit(1).cast("bigint").alias("before"))
    )
    per = checks.groupBy("owner_id", "pos").agg(
        F.count("*").alias("n"), F.bool_or(F.col("after") == 0).alias("supports"),
        F.bool_or((F.col("before") == 0) & (F.col("after") == 1)).alias("weakened"),
    )
    both = viable.join(per, ["owner_id", "pos"], "full")
    return both.groupBy("owner_id").agg(
        F.count_if(F.col("n").isNull()).alias("unchecked"), F.sum(F.coalesce(F.col("n") - 1, F.lit(0))).alias("repeated"),
        (F.count_if(F.col("n").isNull() | (F.col("n") > 1)) == 0).alias("exact"), F.bool_or(F.coalesce("supports", F.lit(False))).alias("some"),
        F.bool_or(F.coalesce("weakened", F.lit(False))).alias("weak"),
    ).select("owner_id", "unchecked", "repeated", (F.col("exact") & F.col("some") & ~F.col("weak")).alias("accepted"))


@query("agg17_derived_owners", "WITH " + matching._CITE + """,
dv AS (SELECT DISTINCT claim_id, owner_id FROM cite), dc AS (SELECT DISTINCT doc_id // 10 AS claim_id, doc_id // 20 AS owner_id FROM documents UNION SELECT DISTINCT doc_id // 10, doc_id // 20 + 1 FROM documents WHERE n_chars < 200)
SELECT claim_id, owner_id, 'derived_only' AS side FROM (SELECT * FROM dv EXCEPT SELECT * FROM dc) UNION ALL SELECT claim_id, owner_id, 'declared_only' FROM (SELECT * FROM dc EXCEPT SELECT * FROM dv)""")
def derived_owners(spark, sf):
    """Owners a claim should name, from its citations, against the ones it declares."""
    derived = matching.citations(spark, sf).select("claim_id", "owner_id").distinct()
    docs = t.table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("claim_id"), F.expr("doc_id div 20").alias("owner_id"), "n_chars")
    extra = docs.filter("n_chars < 200").withColumn("owner_id", F.col("owner_id") + 1)
    declared = docs.unionByName(extra).select("claim_id", "owner_id").distinct()
    from cueloom.operators.rules import one_sided

    return one_sided(derived, declared, ["claim_id", "owner_id"], "derived_only", "declared_only").withColumnRenamed("rule", "side")


@query("agg18_text_ids", """WITH f AS (SELECT sha256(text) AS sha, min(doc_id) AS d FROM documents GROUP BY 1)
SELECT doc_id, printf('t%04d', r) AS text_id FROM documents JOIN (SELECT sha, row_number() OVER (ORDER BY d) AS r FROM f) ON sha = sha256(text)""")
def text_ids(spark, sf):
    """Each distinct text gets an id in order of first use; rows carry the id."""
    docs = t.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    firsts = docs.groupBy("sha").agg(F.min("doc_id").alias("d"))
    ids = ordered.dense_rank_positions(firsts, [], ["d"], "r").select("sha", F.format_string("t%04d", "r").alias("text_id"))
    return docs.join(ids, "sha").select("doc_id", "text_id")


_SIGNALS = """sig AS (SELECT doc_id AS line, 'global' AS signal FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'rule' FROM documents WHERE regexp_matches(text, '[0-9]{4}')
 UNION ALL SELECT line, 'audio' FROM graded WHERE grade IN ('B+', 'B-') UNION ALL SELECT doc_id, 'script' FROM labels WHERE quality = 0)"""


def _signals(spark, sf, graded):
    docs = t.table(spark, sf, "documents")
    mark = lambda df, c, s: df.select(F.col(c).alias("line"), F.lit(s).alias("signal"))
    return (
        mark(docs.filter("n_chars < 200"), "doc_id", "global")
        .unionByName(mark(docs.filter(F.col("text").rlike("[0-9]{4}")), "doc_id", "rule"))
        .unionByName(mark(graded.filter("grade IN ('B+', 'B-')"), "line", "audio"))
        .unionByName(mark(t.table(spark, sf, "labels").filter("quality = 0"), "doc_id", "script"))
    )


@query("agg19_triage_signals", "WITH " + t.VOTE_SQL + "," + evidence._GRADE + ", " + _SIGNALS + " SELECT line, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM sig GROUP BY line")
def triage_signals(spark, sf):
    """Reasons per line; four kinds of signal bound the list."""
    return _signals(spark, sf, evidence.vote_grade(spark, sf)).groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


@query("set2_signal_algebra", "WITH " + t.VOTE_SQL + "," + evidence._GRADE + ", " + _SIGNALS + """,
cf AS (SELECT g.line FROM graded g JOIN labels l ON l.doc_id = g.line WHERE g.grade = 'A' AND l.quality = 0)
SELECT DISTINCT line FROM sig WHERE line NOT IN (SELECT line FROM cf)""")
def signal_algebra(spark, sf):
    """All signals less the lines where script and a unanimous vote contradict each other."""
    script = t.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("line"))
    graded = pin(evidence.vote_grade(spark, sf), "grades")  # two branches read it
    conflict = graded.filter("grade = 'A'").join(script, "line", "left_semi").select("line")
    return _signals(spark, sf, graded).select("line").distinct().join(conflict, "line", "left_anti")


@query("set3_symmetric_difference", "WITH " + matching._CITE + """ SELECT o.observation_id, 'uncited' AS side FROM (SELECT doc_id AS observation_id FROM documents EXCEPT SELECT observation_id FROM cite WHERE claim_id <> observation_id // 10) o
UNION ALL SELECT c.observation_id, 'unlabelled' FROM (SELECT observation_id FROM cite EXCEPT SELECT doc_id FROM labels) c""")
def symmetric_difference(spark, sf):
    cite = matching.citations(spark, sf)
    ids = t.table(spark, sf, "documents").select(F.col("doc_id").alias("observation_id"))
    labelled = t.table(spark, sf, "labels").select(F.col("doc_id").alias("observation_id"))
    uncited = ids.exceptAll(ids.join(cite.filter("claim_id <> observation_id div 10"), "observation_id", "left_semi"))
    unlabelled = cite.select("observation_id").distinct().join(labelled, "observation_id", "left_anti")
    return uncited.withColumn("side", F.lit("uncited")).unionByName(unlabelled.withColumn("side", F.lit("unlabelled")))


@query("set4_role_disjointness", "WITH " + matching._CITE + """,
r AS (SELECT claim_id, observation_id, 'support' AS role FROM cite WHERE observation_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT claim_id, observation_id, 'conflict' FROM cite WHERE observation_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT claim_id, count(*) AS both_roles FROM (SELECT claim_id, observation_id FROM r GROUP BY 1, 2 HAVING count(DISTINCT role) = 2) GROUP BY 1""")
def role_disjointness(spark, sf):
    """Claims that cite one observation both for and against."""
    cite = matching.citations(spark, sf)
    labels = t.table(spark, sf, "labels").withColumnRenamed("doc_id", "observation_id")
    support = cite.join(labels.filter("quality = 1"), "observation_id", "left_semi").select("claim_id", "observation_id")
    conflict = cite.join(labels.filter("toxic = 1"), "observation_id", "left_semi").select("claim_id", "observation_id")
    return support.join(conflict, ["claim_id", "observation_id"], "left_semi").groupBy("claim_id").agg(F.count("*").alias("both_roles"))


@query("top1_cases", """WITH c AS (SELECT doc_id AS case_id, doc_id // 20 AS owner_id, n_chars % 4 AS severity, doc_id % 3 = 0 AS unresolved FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY -severity, unresolved, case_id) AS rn FROM c WHERE severity >= 2)
SELECT case_id, owner_id, severity, unresolved FROM r WHERE rn = 1 ORDER BY -severity, unresolved, owner_id, case_id LIMIT 24""")
def cases(spark, sf):
    """The 24 gravest cases, one per owner (a top-k report)."""
    rows = t.table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"), F.expr("doc_id div 20").alias("owner_id"), F.expr("n_chars % 4").alias("severity"),
        F.expr("doc_id % 3 = 0").alias("unresolved"),
    ).filter("severity >= 2")
    rank = F.struct((-F.col("severity")).alias("s"), "unresolved", "case_id")
    best = rows.groupBy("owner_id").agg(F.min(rank).alias("b"))
    top = best.select(F.col("b.case_id").alias("case_id"), "owner_id", (-F.col("b.s")).alias("severity"), F.col("b.unresolved").alias("unresolved"))
    return top.orderBy(F.desc("severity"), "unresolved", "owner_id", "case_id").limit(24)


@query("top2_first_candidates", "SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 6")
def first_candidates(spark, sf):
    """First six per key; the rank filter is pushed below the shuffle (WindowGroupLimit)."""
    line = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return t.table(spark, sf, "documents").select("lang", "doc_id", F.row_number().over(line).cast("bigint").alias("rn"), "n_chars").filter("rn <= 6").drop("n_chars")
