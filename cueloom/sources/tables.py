"""Model tables derived from the parquet tables, and the same definitions as SQL text.

Every builder reads whole tables.  Bounded groups are bounded by a unique integer key
(``doc_id div 20`` holds at most 20 documents), never by dropping rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cueloom.functions import text as tx
from cueloom.operators import ordered


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table.  Text work is heavy per byte; where text tables come as a few large row
    groups, the setting ``spark.cueloom.textPartitions`` of the session spreads them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("spark.cueloom.textPartitions", None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df


def cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns on a time line: reading time of the text after a pause."""
    lex = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"),
        (F.col("turn") + 1).alias("cue_id"),
        "role",
        "text",
        tx.lexical_count(F.col("text")).alias("n_lex"),
    )
    timed = lex.withColumns(
        {
            "dur_ms": F.expr("greatest(800L, n_lex * 1000 div 9)"),
            "pause_ms": F.expr("600 * (n_lex % 8)"),
        }
    )
    cut = ordered.dense_blocks(timed, "cue_id")
    run = ordered.scan(
        cut, ["episode_id"], ["cue_id"], before={"t0": F.col("dur_ms") + F.col("pause_ms")}
    )
    return run.select(
        "episode_id", "cue_id", "role", "text", "n_lex",
        (F.col("t0") + F.col("pause_ms")).alias("start_ms"),
        (F.col("t0") + F.col("pause_ms") + F.col("dur_ms")).alias("end_ms"),
    )


CUE_SQL = r"""
lex AS (SELECT conv_id AS episode_id, turn + 1 AS cue_id, role, text,
               length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_lex FROM conversations),
timed AS (SELECT *, greatest(800, n_lex * 1000 // 9) AS dur_ms, 600 * (n_lex % 8) AS pause_ms FROM lex),
cue AS (SELECT episode_id, cue_id, role, text, CAST(n_lex AS BIGINT) AS n_lex,
               CAST(sum(dur_ms + pause_ms) OVER w - dur_ms AS BIGINT) AS start_ms,
               CAST(sum(dur_ms + pause_ms) OVER w AS BIGINT) AS end_ms
        FROM timed WINDOW w AS (PARTITION BY episode_id ORDER BY cue_id))"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as source with the assistant turn after it as target."""
    turns = table(spark, sf_dir, "conversations")
    source = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("episode_id"), (F.col("turn") + 1).alias("cue_id"), F.col("text").alias("source")
    )
    target = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("cue_id"), F.col("text").alias("target")
    )
    return source.join(target, ["episode_id", "cue_id"])


PAIR_SQL = """
pair AS (SELECT s.conv_id AS episode_id, s.turn + 1 AS cue_id, s.text AS source, t.text AS target
         FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn + 1
         WHERE s.role = 'user' AND t.role = 'assistant')"""


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as competing readings; 20 consecutive ids share one owner window."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 0, "unavailable").when(F.col("toxic") == 1, "empty").otherwise("ok")
    return docs.join(labels, "doc_id", "left").select(
        F.col("lang").alias("episode_id"),
        F.expr("doc_id div 20").alias("owner_id"),
        F.col("source").alias("observer"),
        F.expr("doc_id % 5").alias("pool_ord"),
        F.col("doc_id").alias("pos"),
        F.expr("(doc_id div 20) * 20000 + (doc_id % 10) * 1000").alias("start_ms"),
        F.expr("(doc_id div 20) * 20000 + (doc_id % 10) * 1000 + 12000").alias("end_ms"),
        F.when(status == "ok", F.col("text")).otherwise("").alias("text"),
        status.alias("status"),
    )


OBSERVATION_SQL = """
observation AS (SELECT lang AS episode_id, d.doc_id // 20 AS owner_id, source AS observer,
    d.doc_id % 5 AS pool_ord, d.doc_id AS pos,
    (d.doc_id // 20) * 20000 + (d.doc_id % 10) * 1000 AS start_ms,
    (d.doc_id // 20) * 20000 + (d.doc_id % 10) * 1000 + 12000 AS end_ms,
    CASE WHEN coalesce(quality, 1) <> 0 AND coalesce(toxic, 0) <> 1 THEN text ELSE '' END AS text,
    CASE WHEN quality = 0 THEN 'unavailable' WHEN toxic = 1 THEN 'empty' ELSE 'ok' END AS status
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("owner_id")).distinct()
    return ids.select(
        "owner_id", (F.col("owner_id") * 20000).alias("start_ms"), (F.col("owner_id") * 20000 + 20000).alias("end_ms")
    )


OWNER_SQL = """
owner AS (SELECT DISTINCT doc_id // 20 AS owner_id, (doc_id // 20) * 20000 AS start_ms,
                 (doc_id // 20) * 20000 + 20000 AS end_ms FROM documents)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View and click events as raw, possibly overlapping, activity intervals."""
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("view", "click"))
        .select(
            "event_id", "user_id", at.alias("s_ms"),
            (at + F.expr("cast(round(value * 1000) as bigint) * 600")).alias("e_ms"),
        )
        .filter("e_ms > s_ms")
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint activity per user: the union of its raw intervals."""
    from cueloom.operators.intervals import union_intervals

    return union_intervals(activity(spark, sf_dir), ["user_id"], "s_ms", "e_ms", "event_id")


ACTIVITY_SQL = """
activity AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS s_ms,
    epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) * 600 AS e_ms
    FROM events WHERE event_type IN ('view', 'click') AND CAST(round(value * 1000) AS BIGINT) > 0)"""

SPEECH_SQL = ACTIVITY_SQL + """,
act_peak AS (SELECT *, max(e_ms) OVER (PARTITION BY user_id ORDER BY s_ms, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM activity),
act_run AS (SELECT *, sum(CASE WHEN pk IS NULL OR s_ms > pk THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY s_ms, event_id) AS run FROM act_peak),
speech AS (SELECT user_id, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM act_run GROUP BY user_id, run)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("stage"),
        F.get_json_object("props", "$.k").cast("bigint").alias("attempt"),
        F.expr("cast(round(value * 1000) as bigint)").alias("millis"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at_ms"),
        "user_id",
    )


TELEMETRY_SQL = """
telemetry AS (SELECT event_id, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) AS attempt,
    CAST(round(value * 1000) AS BIGINT) AS millis, epoch_us(ts) // 1000 AS at_ms, user_id FROM events)"""


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.expr("doc_id div 2").alias("candidate"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE 'confirmation' END").alias("role"),
        F.col("doc_id").alias("started"),
        (F.col("quality") * 4 + F.expr("doc_id % 7")).cast("bigint").alias("overall"),
        (10 - F.col("toxic") * 6 - F.expr("doc_id % 3")).cast("bigint").alias("expression"),
    )


REVIEW_SQL = """
review AS (SELECT doc_id // 2 AS candidate, CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE 'confirmation' END AS role,
    doc_id AS started, CAST(quality * 4 + doc_id % 7 AS BIGINT) AS overall,
    CAST(10 - toxic * 6 - doc_id % 3 AS BIGINT) AS expression FROM labels)"""


def alias_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon surfaces: all words of benchmark items; one surface may name several."""
    words = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("entity_id"),
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("surface"),
    )
    return words.distinct()


ALIAS_SQL = r"""
alias AS (SELECT DISTINCT item_id AS entity_id, w AS surface FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark))"""


def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recognisers' readings of each document line set."""
    d = F.col("doc_id")
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        d.alias("line"),
        t.alias("w"),
        F.when(d % 11 == 0, "").when(d % 7 == 1, F.reverse(t)).when(d % 5 == 2, F.lower(t)).otherwise(t).alias("n"),
        F.when(d % 13 == 0, "").when(d % 7 == 1, F.reverse(t)).when(d % 4 == 1, F.replace(t, F.lit("."), F.lit(",")))
        .when(d % 9 == 3, F.concat(t, F.lit("z"))).otherwise(t).alias("q"),
    )


VOTE_SQL = """
vote AS (SELECT doc_id AS line, text AS w,
    CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 1 THEN reverse(text)
         WHEN doc_id % 5 = 2 THEN lower(text) ELSE text END AS n,
    CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 7 = 1 THEN reverse(text) WHEN doc_id % 4 = 1 THEN replace(text, '.', ',')
         WHEN doc_id % 9 = 3 THEN text || 'z' ELSE text END AS q
    FROM documents)"""


def edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the first word of every target; some rest on a wrong base hash."""
    old = F.regexp_extract("target", r"^(\S+)", 1)
    stale = (F.col("episode_id") * 8 + F.col("cue_id")) % 15 == 0
    return pair(spark, sf_dir).select(
        "episode_id", "cue_id", "source", "target", old.alias("old"),
        F.concat(F.reverse(old), F.lit("-")).alias("new"),
        F.sha2(F.when(stale, F.concat("target", F.lit("#"))).otherwise(F.col("target")), 256).alias("base_hash"),
    )


EDIT_SQL = PAIR_SQL + r""",
edit AS (SELECT episode_id, cue_id, source, target, regexp_extract(target, '^(\S+)', 1) AS old,
    reverse(regexp_extract(target, '^(\S+)', 1)) || '-' AS new,
    sha256(CASE WHEN (episode_id * 8 + cue_id) % 15 = 0 THEN target || '#' ELSE target END) AS base_hash
    FROM pair)"""


def token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each cue timed by character share; every fifth word is squeezed to 20 ms."""
    words = F.filter(F.split(F.replace("text", F.lit("."), F.lit("。")), r"\s+"), lambda w: w != "")
    rows = cue(spark, sf_dir).select(
        "episode_id", "cue_id", "start_ms", "end_ms", F.posexplode(words).alias("at", "text")
    ).withColumn("tok", (F.col("at") + 1).cast("bigint")).drop("at")
    # Ordered by the number that goes out, so that users of that order need not sort again.
    one = Window.partitionBy("episode_id", "cue_id").orderBy("tok")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = rows.withColumn("n", F.length("text")).withColumns({"upto": F.sum("n").over(one), "tot": F.sum("n").over(whole)})
    begin = F.expr("start_ms + (end_ms - start_ms) * (upto - n) div tot")
    finish = F.expr("start_ms + (end_ms - start_ms) * upto div tot")
    return sized.select(
        "episode_id", "cue_id", "tok", "text",
        begin.alias("start_ms"), F.when(F.col("tok") % 5 == 4, begin + 20).otherwise(finish).alias("end_ms"),
        F.col("start_ms").alias("cue_start"), F.col("end_ms").alias("cue_end"),
    )


TOKEN_SQL = CUE_SQL + r""",
wl AS (SELECT *, list_filter(regexp_split_to_array(replace(text, '.', '。'), '\s+'), lambda w: w <> '') AS ws FROM cue),
wu AS (SELECT episode_id, cue_id, start_ms, end_ms, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS tok FROM wl),
wt AS (SELECT *, sum(length(w)) OVER (PARTITION BY episode_id, cue_id ORDER BY tok) AS upto,
       sum(length(w)) OVER (PARTITION BY episode_id, cue_id) AS tot FROM wu),
token AS (SELECT episode_id, cue_id, tok, w AS text, CAST(start_ms + (end_ms - start_ms) * (upto - length(w)) // tot AS BIGINT) AS start_ms,
  CAST(CASE WHEN tok % 5 = 4 THEN start_ms + (end_ms - start_ms) * (upto - length(w)) // tot + 20
       ELSE start_ms + (end_ms - start_ms) * upto // tot END AS BIGINT) AS end_ms,
  start_ms AS cue_start, end_ms AS cue_end FROM wt)"""
