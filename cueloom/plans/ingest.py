"""Source, sink and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import parsing, text as tx, timecode as tc
from cueloom.operators import rules
from cueloom.plans.registry import query
from cueloom.shared import fresh_path
from cueloom.sources import files, tables as t

_TS = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_LINE = _TS.format("start_ms") + " || ' --> ' || " + _TS.format("end_ms")
_RAW = f""",
blk AS (SELECT episode_id, (cue_id - 1) // 64 AS part, cue_id, CASE WHEN cue_id % 7 = 3 THEN 'x' ELSE '' END || cue_id || chr(13) || chr(10) || {_LINE} ||
  CASE WHEN cue_id % 5 = 4 THEN '' ELSE chr(13) || chr(10) || text END AS b FROM cue),
raw AS (SELECT episode_id, part, chr(65279) || string_agg(b, chr(13) || chr(10) || chr(13) || chr(10) ORDER BY cue_id) AS raw FROM blk GROUP BY episode_id, part),
ch AS (SELECT episode_id, part, trim(c) AS c, n - 1 AS chunk_no FROM (SELECT episode_id, part, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS n FROM (
  SELECT episode_id, part, regexp_split_to_array(trim(regexp_replace(replace(raw, chr(65279), ''), '\\r\\n|\\r', chr(10), 'g'), chr(10) || ' '), '\\n\\s*\\n') AS cs FROM raw))),
ln AS (SELECT episode_id, part, chunk_no, string_split(trim(c, chr(10) || ' '), chr(10)) AS l FROM ch)""".replace("\\\\", "\\")


def _raw(spark, sf):
    """Subtitle text of at most 64 cues per record, with broken ids and missing text lines."""
    ident = F.concat(F.when(F.col("cue_id") % 7 == 3, "x").otherwise(""), F.col("cue_id"))
    head = F.concat_ws("\r\n", ident, tc.cue_line(F.col("start_ms"), F.col("end_ms")))
    block = F.when(F.col("cue_id") % 5 == 4, head).otherwise(F.concat_ws("\r\n", head, "text"))
    rows = t.cue(spark, sf).select("episode_id", F.expr("(cue_id - 1) div 64").alias("part"), F.struct("cue_id", block.alias("b")).alias("x"))
    joined = rows.groupBy("episode_id", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return joined.select("episode_id", "part", F.concat(F.lit(files.BOM), F.array_join("xs.b", "\r\n\r\n")).alias("raw"))


@query("src1_lenient_srt", "WITH " + t.CUE_SQL + _RAW + r"""
SELECT episode_id, CAST(l[1] AS BIGINT) AS cue_id, trim(l[2]) AS ts_line, array_to_string(list_transform(l[3:], lambda x: trim(x)), chr(10)) AS text
FROM ln WHERE len(l) >= 3 AND regexp_matches(trim(l[1]), '^\d+$')""")
def lenient_srt(spark, sf):
    return files.parse_srt(_raw(spark, sf), ["episode_id"])


@query("src2_strict_srt", "WITH " + t.CUE_SQL + _RAW + r"""
SELECT episode_id, part, chunk_no, CASE WHEN len(l) < 3 THEN 'under_three_lines' WHEN NOT regexp_matches(trim(l[1]), '^\d+$') THEN 'bad_id' ELSE 'accepted' END AS reject_reason FROM ln""")
def strict_srt(spark, sf):
    found = files.srt_rejections(_raw(spark, sf), ["episode_id", "part"])
    return found.select("episode_id", "part", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason"))


@query("src3_timestamps", "WITH " + t.CUE_SQL + f" SELECT episode_id, cue_id, {_TS.format('end_ms')} AS stamp, end_ms AS ms, end_ms * 16 AS frame FROM cue")
def timestamps(spark, sf):
    stamped = t.cue(spark, sf).select("episode_id", "cue_id", tc.format_ms(F.col("end_ms")).alias("stamp"))
    parsed = stamped.withColumn("ms", tc.parse_ms(F.col("stamp")))
    return parsed.withColumn("frame", tc.frames(F.col("ms")))


@query("src4_json_roundtrip", "WITH " + t.TELEMETRY_SQL + " SELECT event_id, stage, attempt, coalesce(nullif(attempt % 4, 0), -1) AS cycle FROM telemetry")
def json_roundtrip(spark, sf):
    """Records written once as JSON and read back with defaults for absent fields."""
    rows = t.telemetry(spark, sf).select("event_id", "stage", "attempt", F.nullif(F.expr("attempt % 4"), F.lit(0)).alias("cycle"))
    path = fresh_path(spark, "json")
    files.write_json_once(rows, path)
    back = spark.read.schema("event_id bigint, stage string, attempt bigint, cycle bigint").option("mode", "FAILFAST").json(path)
    return back.withColumn("cycle", F.coalesce("cycle", F.lit(-1)).cast("bigint"))


@query("src5_strict_json", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'constant' WHEN 2 THEN 'not_object' WHEN 3 THEN 'malformed' ELSE 'ok' END AS verdict FROM events""")
def strict_json(spark, sf):
    text = F.expr("""CASE event_id % 6 WHEN 0 THEN substring(props, 1, length(props) - 1) || ', "k": 1}' WHEN 1 THEN '{"k": NaN}'
        WHEN 2 THEN '[' || props || ']' WHEN 3 THEN substring(props, 1, length(props) - 1) ELSE props END""")
    return t.table(spark, sf, "events").select("event_id", F.coalesce(parsing.json_rejection(text), F.lit("ok")).alias("verdict"))


@query("src6_jsonl_log", "WITH " + t.TELEMETRY_SQL + " SELECT stage, count(*) AS requests, CAST(sum(millis) AS BIGINT) AS millis, max(attempt) AS last_attempt FROM telemetry GROUP BY stage")
def jsonl_log(spark, sf):
    """Two appends to one log, then a scan."""
    rows = t.telemetry(spark, sf)
    path = fresh_path(spark, "jsonl")
    files.append_jsonl(rows.filter("event_id % 2 = 0"), path)
    files.append_jsonl(rows.filter("event_id % 2 = 1"), path)
    log = spark.read.schema(rows.schema).json(path)
    return log.groupBy("stage").agg(F.count("*").alias("requests"), F.sum("millis").alias("millis"), F.max("attempt").alias("last_attempt"))


@query("src7_encodings", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8-sig' ELSE 'cp932' END AS encoding, sha256(trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'ア' || regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') END, ' ' || chr(10))) AS sha FROM documents".replace("\\\\", "\\"))
def encodings(spark, sf):
    """Half the documents as UTF-8 bytes, half as ASCII after one half-width kana byte (not UTF-8)."""
    legacy = F.concat(F.unhex(F.lit("8341")), F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", ""), "US-ASCII"))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(legacy)
    rows = t.table(spark, sf, "documents").select("doc_id", files.decode_fallback(content).alias("d"))
    return rows.select("doc_id", "d.encoding", tx.digest(F.col("d.text")).alias("sha"))


@query("src8_sampled_context", r"""SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 333) || chr(10) || '...[中略]...' || chr(10) || substr(text, (length(text) - 333) // 2 + 1, 333) || chr(10) || '...[后略]...' || chr(10) || right(text, 333) END) AS sha, length(text) > 1000 AS sampled FROM documents""")
def sampled_context(spark, sf):
    return t.table(spark, sf, "documents").select(
        "doc_id", tx.digest(tx.sample_thirds(F.col("text"), 1000)).alias("sha"), (F.length("text") > 1000).alias("sampled")
    )


@query("src9_word_list", """SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS sha FROM documents""")
def word_list(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", tx.digest(files.word_list(F.col("text"))).alias("sha"))


@query("src10_media_catalogue")
def media_catalogue(spark, sf):
    """The table files themselves, listed by extension."""
    found = files.media_catalogue(spark, sf, ["parquet"])
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("src12_srt_sink", "WITH " + t.CUE_SQL + f" SELECT episode_id, cue_id, {_LINE} AS ts_line, text FROM cue")
def srt_sink(spark, sf):
    """Written per episode and read back by the lenient parser."""
    path = fresh_path(spark, "srt")
    files.write_srt(t.cue(spark, sf), path, "episode_id", "cue_id")
    raw = files.read_records(spark, path).select(F.col("episode_id").cast("bigint").alias("episode_id"), F.col("value").alias("raw"))
    return files.parse_srt(raw, ["episode_id"])


_FIT = "n_lex > 0 AND n_lex % 7 <> 0 AND NOT {}"
_BLANK = r"(text, '\r|(^|\n)\s*(\n|$)')"


@query("src12_exact_sink", "WITH " + t.CUE_SQL + f" SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY cue_id) AS cue_id, {_LINE} AS ts_line, text FROM cue WHERE " + _FIT.format("regexp_matches" + _BLANK))
def exact_sink(spark, sf):
    """Every seventh length left out, the rest renumbered, written, and taken from the files."""
    fit = t.cue(spark, sf).filter(files.unwritable(*map(F.col, ("episode_id", "start_ms", "end_ms", "text"))).isNull() & F.expr("n_lex > 0 AND n_lex % 7 <> 0"))
    held = files.write_srt_exact(fit, fresh_path(spark, "srt"), "episode_id", ["cue_id"])
    return held.select("episode_id", "cue_id", "ts_line", "text")


@query("src2_id_sequence", "WITH " + t.CUE_SQL + " SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY cue_id) AS ordinal, cue_id, row_number() OVER (PARTITION BY episode_id ORDER BY cue_id) = cue_id AS in_sequence FROM cue WHERE " + _FIT.format("regexp_matches" + _BLANK))
def id_sequence(spark, sf):
    """Files whose numbers have gaps: every record with its place and whether its number is that place."""
    path = fresh_path(spark, "srt")
    fit = t.cue(spark, sf).filter(files.unwritable(*map(F.col, ("episode_id", "start_ms", "end_ms", "text"))).isNull() & F.expr("n_lex > 0 AND n_lex % 7 <> 0"))
    files.write_srt(fit, path, "episode_id", "cue_id")
    held = files.read_srt_positions(spark, path, ["episode_id"])
    return held.select(F.col("episode_id").cast("bigint").alias("episode_id"), "ordinal", "cue_id", (F.col("cue_id") == F.col("ordinal")).alias("in_sequence"))


@query("src14_bundle_digest", """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'digest_differs' ELSE 'ok' END AS verdict, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
  CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents""")
def bundle_digest(spark, sf):
    d = t.table(spark, sf, "documents")
    manifest = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("pinned"))
    now = d.select(
        "doc_id", tx.digest(F.col("text")).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes"),
        F.length("text").cast("bigint").alias("chars"), (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("lines"),
    )
    return now.join(manifest, "doc_id", "left").select(
        "doc_id", F.when(F.col("pinned").isNull(), "unregistered").when(F.col("pinned") != F.col("sha"), "digest_differs").otherwise("ok").alias("verdict"),
        "bytes", "chars", "lines",
    )


@query("src15_record_table", "WITH " + t.TELEMETRY_SQL + """
SELECT event_id, CASE WHEN attempt % 2 = 0 THEN CASE WHEN attempt % 3 = 0 THEN 'cycle,note' ELSE 'cycle' END ELSE CASE WHEN attempt % 3 = 0 THEN 'note' ELSE '' END END AS missing, true AS lossless FROM telemetry""")
def record_table(spark, sf):
    """Records with differing fields: absent fields are listed, null fields are kept."""
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    entries = F.array_compact(F.array(
        entry("stage", F.col("stage")),
        F.when(F.expr("attempt % 2 <> 0"), entry("cycle", F.nullif(F.expr("attempt % 5"), F.lit(0)))),
        F.when(F.expr("attempt % 3 <> 0"), entry("note", F.lit(None))),
    ))
    records = t.telemetry(spark, sf).select("event_id", F.map_from_entries(entries).alias("fields"))
    columns = ["cycle", "note", "stage"]
    table = files.to_table(records, ["event_id"], "fields", columns)
    back = files.from_table(table, ["event_id"], columns, "again")
    same = records.join(back, "event_id").select("event_id", (F.to_json("fields") == F.to_json("again")).alias("j"), F.array_sort(F.map_entries("fields")).eqNullSafe(F.array_sort(F.map_entries("again"))).alias("lossless"))
    return table.select("event_id", F.array_join("missing", ",").alias("missing")).join(same.drop("j"), "event_id")


@query("val1_contiguous_ids", "WITH " + t.CUE_SQL + """,
p AS (SELECT episode_id, cue_id + CASE WHEN cue_id > 4 THEN 1 ELSE 0 END AS cue_id, CASE WHEN cue_id % 6 = 5 THEN '  ' ELSE text END AS text FROM cue)
SELECT episode_id, cue_id, 'blank_text' AS rule FROM p WHERE trim(text) = '' UNION ALL
SELECT episode_id, cue_id, 'id_jump' FROM (SELECT *, lag(cue_id, 1, 0) OVER (PARTITION BY episode_id ORDER BY cue_id) AS b FROM p) WHERE cue_id <> b + 1""")
def contiguous_ids(spark, sf):
    """Ids run from 1 without a break: every id but 1 needs its predecessor (a join, not a sort)."""
    rows = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.expr("turn + 1 + CASE WHEN turn > 3 THEN 1 ELSE 0 END").alias("cue_id"),
        F.expr("CASE WHEN turn % 6 = 4 THEN '  ' ELSE text END").alias("text"),
    )
    blank = rows.filter(F.trim("text") == "").select("episode_id", "cue_id", F.lit("blank_text").alias("rule"))
    follows = rows.select("episode_id", (F.col("cue_id") + 1).alias("cue_id"))
    jump = rows.filter("cue_id <> 1").join(follows, ["episode_id", "cue_id"], "left_anti")
    return blank.unionByName(jump.select("episode_id", "cue_id", F.lit("id_jump").alias("rule")))


@query("val6_key_equality", """WITH req AS (SELECT doc_id FROM documents), ans AS (SELECT doc_id * 2 AS doc_id FROM labels)
SELECT doc_id, 'missing' AS rule FROM req WHERE doc_id NOT IN (SELECT doc_id FROM ans) UNION ALL SELECT doc_id, 'foreign' FROM ans WHERE doc_id NOT IN (SELECT doc_id FROM req)""")
def key_equality(spark, sf):
    requested = t.table(spark, sf, "documents").select("doc_id")
    answered = t.table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return rules.one_sided(requested, answered, ["doc_id"], "missing", "foreign")


@query("val7_geometry_equality", "WITH " + t.CUE_SQL + """,
a AS (SELECT * FROM cue WHERE n_lex > 60), b AS (SELECT episode_id, cue_id, start_ms, end_ms + CASE WHEN cue_id % 3 = 1 THEN 40 ELSE 0 END AS end_ms FROM cue WHERE n_lex < 900)
SELECT coalesce(a.episode_id, b.episode_id) AS episode_id, coalesce(a.cue_id, b.cue_id) AS cue_id, CASE WHEN b.cue_id IS NULL THEN 'missing_target' WHEN a.cue_id IS NULL THEN 'missing_source' ELSE 'time_differs' END AS rule
FROM a FULL JOIN b ON a.episode_id = b.episode_id AND a.cue_id = b.cue_id WHERE a.cue_id IS NULL OR b.cue_id IS NULL OR a.start_ms <> b.start_ms OR a.end_ms <> b.end_ms""")
def geometry_equality(spark, sf):
    cues = t.cue(spark, sf).select("episode_id", "cue_id", "n_lex", "start_ms", "end_ms")
    source = cues.filter("n_lex > 60").drop("n_lex").withColumn("in_source", F.lit(True))
    target = cues.filter("n_lex < 900").select(
        "episode_id", "cue_id", F.col("start_ms").alias("t_start"), F.expr("end_ms + CASE WHEN cue_id % 3 = 1 THEN 40 ELSE 0 END").alias("t_end")
    )
    both = source.join(target, ["episode_id", "cue_id"], "full")
    rule = F.when(F.col("t_start").isNull(), "missing_target").when(F.col("in_source").isNull(), "missing_source").when(
        (F.col("start_ms") != F.col("t_start")) | (F.col("end_ms") != F.col("t_end")), "time_differs"
    )
    return both.select("episode_id", "cue_id", rule.alias("rule")).filter("rule IS NOT NULL")


@query("val13_deliverables", r"""WITH f AS (SELECT page_id // 5 AS unit, CASE page_id % 5 WHEN 0 THEN 'ep' || page_id // 5 || '.mp4' WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN 'other.srt' ELSE 'ep' || page_id // 5 || '.srt' END
  WHEN 2 THEN CASE WHEN page_id % 4 = 0 THEN 'ep' || page_id // 5 || '.pre-review.srt' ELSE 'ep' || page_id // 5 || '.zh-Hant.srt' END WHEN 3 THEN 'stray' || page_id || '.srt' ELSE 'notes.txt' END AS name FROM pages),
m AS (SELECT unit, replace(name, '.mp4', '') AS stem FROM f WHERE name LIKE '%.mp4'), s AS (SELECT unit, name FROM f WHERE name LIKE '%.srt'),
tr AS (SELECT m.unit, m.stem, s.name FROM m JOIN s ON s.unit = m.unit AND regexp_matches(s.name, '^' || m.stem || '\.[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*\.srt$') AND NOT contains(s.name, '.pre-')),
k AS (SELECT m.unit, m.stem, EXISTS (SELECT 1 FROM s WHERE s.unit = m.unit AND s.name = m.stem || '.srt') AS src, EXISTS (SELECT 1 FROM tr WHERE tr.unit = m.unit AND tr.stem = m.stem) AS tra FROM m)
SELECT unit, stem || '.mp4' AS name, CASE WHEN NOT src AND tra THEN 'missing-source' WHEN NOT src THEN 'no-speech-subtitles' ELSE 'missing-translation' END AS kind FROM k WHERE NOT (src AND tra)
UNION ALL SELECT s.unit, s.name, 'orphan-subtitles' FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit = s.unit AND s.name = m.stem || '.srt') AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.unit = s.unit AND tr.name = s.name)""")
def deliverables(spark, sf):
    name = F.expr("""CASE page_id % 5 WHEN 0 THEN 'ep' || page_id div 5 || '.mp4' WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN 'other.srt' ELSE 'ep' || page_id div 5 || '.srt' END
        WHEN 2 THEN CASE WHEN page_id % 4 = 0 THEN 'ep' || page_id div 5 || '.pre-review.srt' ELSE 'ep' || page_id div 5 || '.zh-Hant.srt' END WHEN 3 THEN 'stray' || page_id || '.srt' ELSE 'notes.txt' END""")
    listing = t.table(spark, sf, "pages").select(F.expr("page_id div 5").alias("unit"), name.alias("name"))
    return rules.deliverable_findings(listing, "unit", "name")


@query("val14_replay", "WITH " + t.CUE_SQL + """,
g AS (SELECT episode_id, cue_id, cell FROM cue c, unnest(range(c.start_ms // 120000, (c.end_ms - 1) // 120000 + 1)) AS x(cell)),
st AS (SELECT episode_id, cue_id, cell + CASE WHEN cue_id = 3 AND episode_id % 4 = 0 THEN 1 ELSE 0 END AS cell FROM g)
SELECT * FROM (SELECT *, 'left' AS side FROM (SELECT * FROM st EXCEPT ALL SELECT * FROM g)) UNION ALL SELECT * FROM (SELECT *, 'right' AS side FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM st))""")
def replay(spark, sf):
    """A stored artefact against its recomputation."""
    from cueloom.plans.geometry import grid_cells
    from cueloom.shared import pin

    now = grid_cells(spark, sf).select("episode_id", "cue_id", "cell")
    stored = pin(now.withColumn("cell", F.expr("cell + CASE WHEN cue_id = 3 AND episode_id % 4 = 0 THEN 1 ELSE 0 END")), "stored")
    return rules.difference(stored, now)
