"""Scalar text, parsing and text-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import parsing, text as tx, timecode as tc
from cueloom.operators import layout
from cueloom.plans.registry import query
from cueloom.sources import tables as t


def docs(spark, sf):
    return t.table(spark, sf, "documents")


@query("txt1_compact", r"SELECT doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{N}ー]', '', 'g'))) AS sha FROM documents")
def compact(spark, sf):
    return docs(spark, sf).select("doc_id", tx.digest(tx.compact(F.col("text"), normalise=False)).alias("sha"))


@query("txt1_compact_nfkc")
def compact_nfkc(spark, sf):
    return docs(spark, sf).select("doc_id", tx.digest(tx.compact(F.col("text"))).alias("sha"))


@query("txt2_reading", """SELECT doc_id, sha256(translate(replace(regexp_replace(lower(text), '[\\s、。，,！!?？「」『』・…\\-—.·()（）:：;；]', '', 'g'), 'ー', ''), 'っぁぃぅぇぉゃゅょゎゕゖ', 'つあいうえおやゆよわかけ')) AS sha FROM documents""")
def reading(spark, sf):
    return docs(spark, sf).select("doc_id", tx.digest(tx.kana_reading(F.col("text"))).alias("sha"))


@query("txt3_lexical_count", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS BIGINT) AS lexical, CAST(length(trim(replace(text, chr(10), ''))) AS BIGINT) AS visible FROM documents")
def lexical_count(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.lexical_count(F.col("text")).alias("lexical"), tx.visible_length(F.col("text")).alias("visible")
    )


@query("txt4_repetition")
def repetition(spark, sf):
    return docs(spark, sf).select("doc_id", tx.suspicious(F.col("text")).alias("suspicious"))


@query("txt5_compression")
def compression(spark, sf):
    return docs(spark, sf).select("doc_id", tx.compression_ratio("text").alias("ratio")).withColumn(
        "passed", F.col("ratio") <= tx.REPEAT_THRESHOLD
    )


@query("txt6_markers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+(?:\.\d+)?'), ' ') AS numbers, CAST(len(regexp_extract_all(text, 'ません|ない|無い|なかった|なければ|なく|ずに')) AS BIGINT) AS negations FROM documents")
def markers(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.array_join(tx.numbers_in(F.col("text")), " ").alias("numbers"),
        F.size(tx.negations_in(F.col("text"))).cast("bigint").alias("negations"),
    )


_MARKED = "replace(replace(text, '.', '。'), ',', '，')"


@query("txt7_convention", rf"""WITH m AS (SELECT doc_id, {_MARKED} AS x FROM documents),
c AS (SELECT doc_id, x, trim(regexp_replace(regexp_replace(x, '[。，；：]', ' ', 'g'), '\s+', ' ', 'g')) AS y FROM m)
SELECT doc_id, sha256(y) AS sha, CAST(length(y) AS BIGINT) AS n, regexp_replace(x, '[。，；：\s]', '', 'g') = regexp_replace(y, '[。，；：\s]', '', 'g') AS preserved FROM c""")
def convention(spark, sf):
    marked = docs(spark, sf).select("doc_id", F.expr(_MARKED).alias("x"))
    done = marked.withColumn("y", tx.convention(F.col("x")))
    return done.select(
        "doc_id", tx.digest(F.col("y")).alias("sha"), F.length("y").cast("bigint").alias("n"),
        tx.preserved(F.col("x"), F.col("y")).alias("preserved"),
    )


_PREFIX = "|".join(p.replace("(?i)", "").lstrip("^") for p in tx.TITLE_PREFIXES)


@query("txt8_titles", rf"""
WITH s AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS stem FROM pages),
c AS (SELECT page_id, trim(regexp_replace(CASE page_id % 4 WHEN 0 THEN '01.【PV】' WHEN 1 THEN 'track 7 - ' WHEN 2 THEN '[x] 002_' ELSE '' END || stem,
      '(?i)^(?:{_PREFIX})+', '')) AS title FROM s)
SELECT page_id, title, length(title) >= 2 AND NOT regexp_matches(title, '{tx.TITLE_MEANINGLESS}')
  AND lower(title) NOT IN {tx.TITLE_GENERIC}
  AND (regexp_matches(title, '[\x{{3040}}-\x{{30ff}}]') OR len(regexp_extract_all(title, '[\x{{4e00}}-\x{{9fff}}]')) >= 2 OR regexp_matches(title, '[A-Za-z]{{2,}}')) AS meaningful FROM c""")
def titles(spark, sf):
    """Page title as media stem with batch prefixes put in front."""
    stem = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    tag = F.element_at(F.array(*[F.lit(p) for p in ("01.【PV】", "track 7 - ", "[x] 002_", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    cleaned = tx.clean_title(F.concat(tag, stem))
    return t.table(spark, sf, "pages").select(
        "page_id", cleaned.alias("title"), tx.meaningful_title(cleaned).alias("meaningful")
    )


@query("txt9_script_lines", rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT doc_id, string_split(replace(text, '.', '。'), chr(10)) AS ls FROM documents)),
s AS (SELECT doc_id, n, regexp_replace(trim(line), '{tx.SPEAKER}', '') AS said FROM l WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '{tx.STAGE_ONLY}')),
p AS (SELECT doc_id, n, unnest(ps) AS part, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, n, regexp_extract_all(said, '[^。！？!?…]*[。！？!?…]+|[^。！？!?…]+') AS ps FROM s))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INT) AS "at", trim(part) AS sentence
FROM p WHERE trim(part) <> '' AND NOT regexp_matches(trim(part), '{tx.STAGE_ONLY}')""")
def script_lines(spark, sf):
    marked = F.replace("text", F.lit("."), F.lit("。"))
    return docs(spark, sf).select("doc_id", F.posexplode(tx.script_sentences(marked)).alias("at", "sentence"))


@query("txt10_sentences", r"""WITH p AS (SELECT doc_id, regexp_extract_all(replace(text, '.', '。'),
 '(?s)(?:[^\p{L}\p{N}]*[\p{L}\p{N}].*?(?:…*[。？！?!]+[」』）)”’]*|\z)(?:[^\p{L}\p{N}]+\z)?)|(?:.+)') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest,
  array_to_string(s, '') = (SELECT replace(text, '.', '。') FROM documents d WHERE d.doc_id = p.doc_id) AS lossless FROM p""")
def sentences(spark, sf):
    marked = docs(spark, sf).withColumn("x", F.replace("text", F.lit("."), F.lit("。")))
    split = marked.withColumn("s", tx.sentences(F.col("x")))
    return split.select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"),
        F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"), (F.array_join("s", "") == F.col("x")).alias("lossless"),
    )


@query("txt11_residue", "SELECT doc_id, regexp_matches(text, '[A-Za-z]{3,}') AND NOT regexp_matches(text, '[぀-ヿ]') AS latin, regexp_matches(text, '[぀-ヿ]') AS kana FROM documents")
def residue(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.latin_residue(F.col("text")).alias("latin"), tx.kana_residue(F.col("text")).alias("kana")
    )


@query("txt12_fix_rejection", "WITH " + t.PAIR_SQL + """,
v AS (SELECT episode_id, cue_id, source, target, CASE cue_id % 3 WHEN 0 THEN '' WHEN 1 THEN upper(target) ELSE source END AS val FROM pair),
n AS (SELECT *, length(trim(replace(val, chr(10), ''))) AS m, length(trim(replace(source, chr(10), ''))) AS r FROM v)
SELECT episode_id, cue_id, CASE WHEN val = '' THEN 'empty' WHEN m > greatest(3 * r, 20) THEN 'too_long' WHEN r <= 3 THEN 'ok'
  WHEN m * 5 < greatest(5, least(r, (r - 8) * 5)) THEN 'too_short' ELSE 'ok' END AS verdict FROM n""")
def fix_rejection(spark, sf):
    value = F.expr("CASE cue_id % 3 WHEN 0 THEN '' WHEN 1 THEN upper(target) ELSE source END")
    return t.pair(spark, sf).select(
        "episode_id", "cue_id",
        F.coalesce(tx.fix_rejection(value, F.col("target"), F.col("source")), F.lit("ok")).alias("verdict"),
    )


_ANSWER = r"""ans AS (SELECT conv_id, turn // 64 AS part, count(*) AS expected FROM conversations GROUP BY 1, 2),
ln AS (SELECT conv_id, turn // 64 AS part, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 99 WHEN conv_id % 3 = 0 AND turn = 2 THEN 2 ELSE turn % 64 + 1 END AS number,
       trim(regexp_replace(text, '\s+', ' ', 'g')) AS value FROM conversations WHERE turn <> 3)"""


def _answers(spark, sf):
    """One answer per block of 64 turns of a conversation; some ids foreign, repeated or missing."""
    turns = t.table(spark, sf, "conversations").select(
        "conv_id", F.expr("turn div 64").alias("part"), F.col("turn").alias("turn"),
        F.expr("CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 99 WHEN conv_id % 3 = 0 AND turn = 2 THEN 2 ELSE turn % 64 + 1 END").alias("n"),
        F.regexp_replace("text", r"\s+", " ").alias("text"),
    )
    line = F.when(F.col("turn") != 3, F.format_string("[%d] %s", "n", "text"))
    return turns.groupBy("conv_id", "part").agg(
        F.count("*").alias("expected"), F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("turn", line.alias("l"))))).alias("ls")
    ).select("conv_id", "part", "expected", F.array_join("ls.l", "\n").alias("answer"))


@query("txt13_strict_answers", "WITH " + _ANSWER + """,
bad AS (SELECT DISTINCT l.conv_id, l.part FROM ln l JOIN ans a ON a.conv_id = l.conv_id AND a.part = l.part WHERE value <> '' AND number > expected)
SELECT conv_id, part, number, sha256(min(value)) AS sha FROM ln WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.conv_id = ln.conv_id AND bad.part = ln.part)
GROUP BY conv_id, part, number HAVING count(*) = 1""")
def strict_answers(spark, sf):
    got = parsing.parse_answers(_answers(spark, sf), ["conv_id", "part"], "answer", "expected")
    return got.select("conv_id", "part", "number", tx.digest(F.col("value")).alias("sha"))


@query("txt13_lenient_answers", "WITH " + _ANSWER + """,
f AS (SELECT conv_id, part, number, arg_max(value, turn) AS value FROM ln WHERE value <> '' GROUP BY 1, 2, 3)
SELECT a.conv_id, a.part, CAST(g.n AS BIGINT) AS number, sha256(coalesce(f.value, '')) AS sha, f.value IS NULL AS missing
FROM ans a, unnest(range(1, a.expected + 1)) AS g(n) LEFT JOIN f ON f.conv_id = a.conv_id AND f.part = a.part AND f.number = g.n""")
def lenient_answers(spark, sf):
    got = parsing.last_answers(_answers(spark, sf), ["conv_id", "part"], "answer", "expected")
    return got.select("conv_id", "part", "number", tx.digest(F.col("value")).alias("sha"), "missing")


@query("txt14_comments")
def comments(spark, sf):
    """Critic comments written from each document's lines, with bullets, marks and foreign numbers."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.concat(
            F.when(i % 3 == 0, "- ").otherwise(""),
            F.when(i % 4 == 1, F.concat(F.lit("["), i + 1, F.lit("] "))).when(i % 4 == 2, F.concat(F.lit("第"), i * 5, F.lit("行: ")))
            .when(i % 4 == 3, "").otherwise(F.concat(i + 1, F.lit(": "))), s,
        ),
    )
    answers = docs(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("answer"), F.size(lines).alias("n_lines"))
    return parsing.comments(answers, ["doc_id"], "answer", "n_lines")


@query("txt15_clip", r"SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 160 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 159) || '…' END AS note FROM documents")
def clip(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clip(tx.collapse(F.col("text")), 160).alias("note"))


@query("txt16_unique_span", "WITH " + t.EDIT_SQL + """
SELECT episode_id, cue_id, CAST(len(list_filter(range(1, length(target) + 1), lambda i: substr(target, i, length(old)) = old)) AS BIGINT) AS places,
  CASE WHEN length(old) > 160 THEN 'target_span_over_160_codepoints' WHEN length(target) > 100 AND length(old) * 5 > length(target) * 3 THEN 'target_span_over_60_percent' ELSE 'ok' END AS limit_rule FROM edit""")
def unique_span(spark, sf):
    return t.edit(spark, sf).select(
        "episode_id", "cue_id", tx.occurrences(F.col("target"), F.col("old")).alias("places"),
        F.coalesce(tx.span_rejection(F.col("target"), F.col("old")), F.lit("ok")).alias("limit_rule"),
    )


@query("txt17_anchor", "WITH " + t.EDIT_SQL + """,
w AS (SELECT episode_id, cue_id, old, target, CASE WHEN cue_id % 2 = 0 THEN replace(target, old, new) ELSE source || ' ' || new END AS wit, new FROM edit),
a AS (SELECT *, substr(target, instr(target, old) + length(old), 4) AS rt FROM w WHERE instr(target, old) = 1)
SELECT episode_id, cue_id, length(rt) >= 2 AND len(list_filter(range(1, length(wit) + 1), lambda i: substr(wit, i, length(new)) = new AND contains(substr(wit, i + length(new), 24), rt))) > 0 AS anchored FROM a""")
def anchor(spark, sf):
    witness = F.when(F.col("cue_id") % 2 == 0, F.replace("target", F.col("old"), F.col("new"))).otherwise(
        F.concat_ws(" ", "source", "new")
    )
    rows = t.edit(spark, sf).withColumn("witness", witness)
    return rows.select(
        "episode_id", "cue_id", tx.anchored(F.col("target"), F.col("old"), F.col("new"), F.col("witness")).alias("anchored")
    )


@query("txt18_fingerprint", """SELECT conv_id, sha256(string_agg(sha256(turn || '|' || role || '|' || text), ',' ORDER BY turn)) AS fingerprint, count(*) AS n FROM conversations GROUP BY conv_id, turn // 64""")
def fingerprint(spark, sf):
    """Record hashes, then one hash per ordered block of 64 turns."""
    rows = t.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr("turn div 64").alias("part"), F.sha2(F.concat_ws("|", "turn", "role", "text"), 256).alias("h")
    )
    return rows.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("hs"), F.count("*").alias("n")
    ).select("conv_id", F.sha2(F.array_join("hs.h", ","), 256).alias("fingerprint"), "n")


@query("txt19_exact_time", "WITH " + t.CUE_SQL + """
SELECT episode_id, cue_id, printf('%02d:%02d.%02d', start_ms // 60000, start_ms // 1000 % 60, start_ms % 1000 // 10) AS clock,
  start_ms * 16 AS frame, start_ms * 16 // 1280 AS bin, start_ms * 16 % 1280 AS rest FROM cue""")
def exact_time(spark, sf):
    frame = tc.frames(F.col("start_ms"))
    return t.cue(spark, sf).select(
        "episode_id", "cue_id", tc.clock(F.col("start_ms")).alias("clock"), frame.alias("frame"),
        F.expr("start_ms * 16 div 1280").alias("bin"), (frame % 1280).alias("rest"),
    )


@query("txt20_restore_parts")
def restore_parts(spark, sf):
    """Sentences without their punctuation, cut back out of the exact text."""
    cues = t.cue(spark, sf).select("episode_id", "cue_id", "text")
    return layout.restore_parts(cues, ["episode_id", "cue_id"], "text")


@query("txt21_blank_lines", r"SELECT doc_id, sha256(regexp_replace(text, '\n *(?:\n *)+', ' ', 'g')) AS sha, regexp_replace(regexp_replace(text, '\n *(?:\n *)+', ' ', 'g'), '\s', '', 'g') = regexp_replace(text, '\s', '', 'g') AS lossless FROM documents")
def blank_lines(spark, sf):
    flat = F.regexp_replace("text", r"\n *(?:\n *)+", " ")
    return docs(spark, sf).select(
        "doc_id", tx.digest(flat).alias("sha"),
        (F.regexp_replace(flat, r"\s", "") == F.regexp_replace("text", r"\s", "")).alias("lossless"),
    )


@query("txt22_orthography", "WITH " + t.PAIR_SQL + r"""
SELECT episode_id, cue_id, upper(source) = upper(v) AND array_to_string(regexp_extract_all(source, '[A-Z]'), '') <> array_to_string(regexp_extract_all(v, '[A-Z]'), '') AS conflict
FROM (SELECT *, CASE WHEN cue_id % 4 = 2 THEN lower(source) ELSE source END AS v FROM pair)""")
def orthography(spark, sf):
    """Same reading, other letters: capitals take the place of ideographs on these tables."""
    other = F.when(F.col("cue_id") % 4 == 2, F.lower("source")).otherwise(F.col("source"))
    marks = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("([A-Z])"), F.lit(1)), "")
    return t.pair(spark, sf).select(
        "episode_id", "cue_id", ((F.upper("source") == F.upper(other)) & (marks(F.col("source")) != marks(other))).alias("conflict")
    )


@query("val10_forbidden_text", r"""WITH d AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN text || chr(10) || chr(10) || 'x' WHEN 1 THEN text || ' 00:01:02,500' WHEN 2 THEN '<think>' || text WHEN 3 THEN text || '```' WHEN 4 THEN '' ELSE repeat(text, 5) END AS e FROM documents)
SELECT doc_id, 'empty' AS rule FROM d WHERE trim(e) = '' UNION ALL SELECT doc_id, 'blank_line' FROM d WHERE regexp_matches(e, '\n\s*\n')
UNION ALL SELECT doc_id, 'timestamp' FROM d WHERE regexp_matches(e, '\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}') UNION ALL SELECT doc_id, 'reasoning' FROM d WHERE regexp_matches(e, '(?i)</?think(?:ing)?>')
UNION ALL SELECT doc_id, 'marker' FROM d WHERE contains(e, '```') OR regexp_matches(e, '[⟦⟧]')
UNION ALL SELECT doc_id, 'control' FROM d WHERE regexp_matches(replace(e, chr(10), ''), '[\p{Cc}\p{Cf}]') UNION ALL SELECT doc_id, 'runaway' FROM d WHERE length(trim(e)) > greatest(160, length(text) * 4)""")
def forbidden_text(spark, sf):
    edited = F.expr("CASE doc_id % 6 WHEN 0 THEN text || '\n\nx' WHEN 1 THEN text || ' 00:01:02,500' WHEN 2 THEN '<think>' || text WHEN 3 THEN text || '```' WHEN 4 THEN '' ELSE repeat(text, 5) END")
    rows = docs(spark, sf).select("doc_id", edited.alias("e"), F.col("text").alias("s"))
    return rows.select("doc_id", F.explode(tx.forbidden_reasons(F.col("e"), F.col("s"))).alias("rule"))


@query("val11_exact_parts", """SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS parts, doc_id % 8 <> 3 OR NOT contains(text, ' ') AS exact FROM documents""")
def exact_parts(spark, sf):
    """Ordered parts must rebuild the text; every eighth document lost its separators."""
    # A text moves once and is cut where its document is; as rows, every part would carry the whole text.
    whole = docs(spark, sf).groupBy("doc_id").agg(F.collect_list("text").alias("texts")).filter("size(texts) > 0")
    numbered = F.transform("texts", lambda t: F.transform(F.split(t, " "), lambda part, at: F.struct(at.alias("at"), part.alias("part"))))
    parts = whole.select("doc_id", F.get("texts", F.lit(0)).alias("text"), F.sort_array(F.flatten(numbered)).alias("ps"))
    rebuilt = F.when(F.col("doc_id") % 8 == 3, F.array_join("ps.part", "")).otherwise(F.array_join("ps.part", " "))
    return parts.select("doc_id", F.size("ps").cast("bigint").alias("parts"), (rebuilt == F.col("text")).alias("exact"))


@query("val8_score_domain", "WITH " + t.REVIEW_SQL + """
SELECT started, CASE WHEN overall NOT BETWEEN 0 AND 9 THEN 'overall_range' WHEN expression NOT BETWEEN 3 AND 10 THEN 'expression_range' WHEN overall > expression + 4 THEN 'incoherent' ELSE 'ok' END AS rule FROM review""")
def score_domain(spark, sf):
    return t.review(spark, sf).select(
        "started", F.when(~F.col("overall").between(0, 9), "overall_range").when(~F.col("expression").between(3, 10), "expression_range")
        .when(F.col("overall") > F.col("expression") + 4, "incoherent").otherwise("ok").alias("rule")
    )


@query("val12_budgets", "WITH " + t.OBSERVATION_SQL + """
SELECT owner_id, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) > 19 AS over_rows, sum(octet_length(encode(text))) > 40000 AS over_bytes FROM observation WHERE status = 'ok' GROUP BY owner_id""")
def budgets(spark, sf):
    return t.observation(spark, sf).filter("status = 'ok'").groupBy("owner_id").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"),
    ).withColumns({"over_rows": F.col("n") > 19, "over_bytes": F.col("bytes") > 40000})
