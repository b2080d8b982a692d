"""Citation, neighbourhood, dictionary and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.operators import align, dictionary, ordered
from cueloom.plans.registry import query
from cueloom.shared import pin
from cueloom.sources import tables as t

_CLAIM = """claim AS (SELECT doc_id, text, [substr(text, 1, 20), substr(text, 5, 15), CASE WHEN doc_id % 4 = 0 THEN 'zz' || doc_id ELSE substr(text, 2, 9) END] AS q FROM documents)"""


@query("jn7_literal_citations", "WITH " + _CLAIM + """ SELECT doc_id, CAST(len(q) AS BIGINT) AS quotes FROM claim WHERE len(list_filter(q, lambda x: x = '' OR NOT contains(text, x))) = 0""")
def literal_citations(spark, sf):
    """Claims whose every quote is literal, non-empty text of the cited row."""
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    quotes = docs.select("doc_id", F.explode(F.expr(
        "array(substring(text, 1, 20), substring(text, 5, 15), CASE WHEN doc_id % 4 = 0 THEN 'zz' || doc_id ELSE substring(text, 2, 9) END)"
    )).alias("quote"))
    seen = quotes.join(docs, "doc_id").withColumn("ok", (F.col("quote") != "") & F.col("text").contains(F.col("quote")))
    per = seen.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("quotes"))
    return per.filter("ok").drop("ok")


_CITE = """cite AS (SELECT doc_id // 10 AS claim_id, doc_id AS observation_id, doc_id // 20 AS owner_id FROM documents
  UNION SELECT doc_id // 10, doc_id * 3 // 2, doc_id * 3 // 2 // 20 FROM documents WHERE n_chars < 400 AND doc_id * 3 // 2 <= (SELECT max(doc_id) FROM documents))"""


def citations(spark, sf):
    docs = t.table(spark, sf, "documents").select("doc_id", "n_chars")
    own = docs.select(F.expr("doc_id div 10").alias("claim_id"), F.col("doc_id").alias("observation_id"))
    far = docs.filter("n_chars < 400").select(F.expr("doc_id div 10").alias("claim_id"), F.expr("doc_id * 3 div 2").alias("observation_id"))
    known = docs.agg(F.max("doc_id").alias("top"))
    far = far.crossJoin(F.broadcast(known)).filter("observation_id <= top").drop("top")  # one row: the largest id
    return own.unionByName(far).distinct().withColumn("owner_id", F.expr("observation_id div 20"))


@query("jn8_focus_expansion", "WITH " + _CITE + """
SELECT DISTINCT observation_id FROM cite WHERE claim_id IN (SELECT claim_id FROM cite WHERE owner_id IN (SELECT doc_id // 20 FROM labels WHERE toxic = 1)) UNION SELECT doc_id FROM documents WHERE doc_id // 20 IN (SELECT doc_id // 20 FROM labels WHERE toxic = 1)""")
def focus_expansion(spark, sf):
    """Focus owners are those with a toxic label."""
    edges = citations(spark, sf)
    focus = t.table(spark, sf, "labels").filter("toxic = 1").select(F.expr("doc_id div 20").alias("owner_id")).distinct()
    touched = edges.join(focus, "owner_id", "left_semi").select("claim_id").distinct()
    cited = edges.join(touched, "claim_id", "left_semi").select("observation_id")
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("observation_id"), F.expr("doc_id div 20").alias("owner_id"))
    own = docs.join(focus, "owner_id", "left_semi").select("observation_id")
    return cited.unionByName(own).distinct()


@query("jn9_neighbourhood", "WITH " + t.EDIT_SQL + """
SELECT c.conv_id AS episode_id, c.turn + 1 AS cue_id, min(abs(c.turn + 1 - e.cue_id)) AS distance, count(*) AS targets
FROM edit e JOIN conversations c ON c.conv_id = e.episode_id AND c.turn + 1 BETWEEN e.cue_id - 2 AND e.cue_id + 2 GROUP BY 1, 2""")
def neighbourhood(spark, sf):
    """Rows within two of a target, with their distance: targets fan out, the join is on the id."""
    spread = t.edit(spark, sf).select(
        "episode_id", F.col("cue_id").alias("target"), F.explode(F.expr("sequence(cue_id - 2, cue_id + 2)")).alias("cue_id")
    )
    near = spread.groupBy("episode_id", "cue_id").agg(
        F.min(F.abs(F.col("cue_id") - F.col("target"))).alias("distance"), F.count("*").alias("targets")
    )
    rows = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("episode_id"), (F.col("turn") + 1).alias("cue_id"))
    return near.join(rows, ["episode_id", "cue_id"])


_SCRIPT = r"""
sent AS (SELECT item_id, s, n FROM (SELECT item_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS n FROM (SELECT item_id, regexp_extract_all(replace(text, '.', '。'),
 '(?s)(?:[^\p{L}\p{N}]*[\p{L}\p{N}].*?(?:…*[。？！?!]+[」』）)”’]*|\z)(?:[^\p{L}\p{N}]+\z)?)|(?:.+)') AS p FROM benchmark))),
num AS (SELECT row_number() OVER (ORDER BY item_id, n) AS idx, item_id, n, lower(regexp_replace(s, '[^\p{L}\p{N}ー]', '', 'g')) AS c FROM sent),
runs AS (SELECT a.idx, k AS span, (SELECT string_agg(b.c, '' ORDER BY b.idx) FROM num b WHERE b.item_id = a.item_id AND b.idx BETWEEN a.idx AND a.idx + k - 1) AS c
  FROM num a, unnest(range(1, 5)) AS g(k) WHERE EXISTS (SELECT 1 FROM num z WHERE z.item_id = a.item_id AND z.idx = a.idx + k - 1)),
ln AS (SELECT DISTINCT lower(regexp_replace(text, '[^\p{L}\p{N}ー]', '', 'g')) AS c FROM conversations),
lg AS (SELECT c, substr(c, i, 2) AS g, count(*) AS n FROM ln, unnest(range(1, length(c))) AS x(i) GROUP BY 1, 2),
rg AS (SELECT idx, span, substr(c, i, 2) AS g, count(*) AS n FROM runs, unnest(range(1, length(c))) AS x(i) GROUP BY 1, 2, 3),
pr AS (SELECT l.c, r.idx, r.span, sum(least(l.n, r.n)) AS shared FROM lg l JOIN rg r ON r.g = l.g GROUP BY 1, 2, 3),
sc AS (SELECT p.c, p.idx, p.span, shared, length(p.c) - 1 AS ls, length(r.c) - 1 AS rs, r.c AS rc, 2000000 * shared // (length(p.c) + length(r.c) - 2) AS dice FROM pr p JOIN runs r ON r.idx = p.idx AND r.span = p.span)"""


def _scored(spark, sf):
    """Distinct lines against runs of script sentences; copies of a line or a run are compared once."""
    marked = t.table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.sentences(F.replace("text", F.lit("."), F.lit("。")))).alias("n", "s"))
    placed = ordered.dense_rank_positions(marked, [], ["item_id", "n"], "idx")
    sentences = placed.select("item_id", "idx", tx.compact(F.col("s"), normalise=False).alias("c"))
    runs = align.sentence_runs(sentences, "item_id", "idx", "c").withColumn("run_sha", F.sha2("run", 256))
    lines = t.table(spark, sf, "conversations").select(tx.compact(F.col("text"), normalise=False).alias("c")).distinct()
    left = lines.withColumn("line", F.sha2("c", 256))
    right = runs.select("run_sha", F.col("run").alias("c")).distinct()
    pairs = align.dice_join(left, right, "line", "run_sha", "c")
    return pairs.join(runs.select("run_sha", "idx", "span"), "run_sha")


@query("jn11_script_dice", "WITH " + _SCRIPT + """
SELECT sha256(c) AS line, idx, CAST(span AS INT) AS span, CAST(dice AS BIGINT) AS dice, CASE WHEN c = rc OR dice >= 920000 OR 1000000 * shared // ls >= 930000 OR 1000000 * shared // rs >= 930000 THEN 'high' ELSE 'mismatch' END AS status
FROM sc WHERE dice >= 600000""")
def script_dice(spark, sf):
    pairs = _scored(spark, sf)
    return pairs.select("line", "idx", "span", "dice", align.match_status(F.col("line") == F.col("run_sha")).alias("status"))


@query("jn11_monotone_anchors")
def monotone_anchors(spark, sf):
    """Per conversation the anchors that keep (nearly) increasing script order."""
    pairs = _scored(spark, sf)
    rows = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), (F.col("turn") + 1).alias("cue_id"),
        F.sha2(tx.compact(F.col("text"), normalise=False), 256).alias("line"),
    )
    scored = rows.join(pairs.select("line", "idx", "span", "dice"), "line").drop("line")
    return align.monotone_anchors(pin(scored, "scored"), ["episode_id"], "cue_id")


@query("jn12_name_occurrences", "WITH " + t.ALIAS_SQL + r""",
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS surface FROM documents),
a AS (SELECT surface, count(*) AS entities, min(entity_id) AS first_entity FROM alias GROUP BY 1)
SELECT doc_id, w.surface, count(*) AS places, entities, first_entity, entities > 1 AS ambiguous FROM w JOIN a ON a.surface = w.surface GROUP BY ALL""")
def name_occurrences(spark, sf):
    surfaces = t.alias_words(spark, sf).groupBy("surface").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first_entity"))
    found = dictionary.occurrences(t.table(spark, sf, "documents"), ["doc_id"], "text", surfaces)
    per = found.groupBy("doc_id", "surface", "entities", "first_entity").agg(F.count("*").alias("places"))
    return per.withColumn("ambiguous", F.col("entities") > 1)


@query("jn12_longest_name", "WITH " + t.ALIAS_SQL + r""",
b AS (SELECT item_id AS id, unnest(p) AS part, unnest(range(len(p))) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+') AS p FROM benchmark)),
bt AS (SELECT id, part, lead(part) OVER w AS gap, lead(part, 2) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY id ORDER BY k)),
nm AS (SELECT surface, 1 AS words, count(*) AS entities FROM alias GROUP BY 1
  UNION ALL SELECT part || ' ' || nxt, 2, count(DISTINCT id) FROM bt WHERE gap = ' ' AND nxt IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+') AS p FROM documents)),
w AS (SELECT doc_id, k, part AS one, CASE WHEN lead(part) OVER w = ' ' THEN part || ' ' || lead(part, 2) OVER w END AS two
      FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
two AS (SELECT doc_id, k, entities FROM w JOIN nm ON nm.surface = two AND words = 2),
one AS (SELECT w.doc_id, w.k, nm.entities FROM w JOIN nm ON nm.surface = one AND words = 1
        ANTI JOIN (SELECT doc_id, k FROM two UNION SELECT doc_id, k + 2 FROM two) c ON c.doc_id = w.doc_id AND c.k = w.k)
SELECT doc_id, words, count(*) AS places, count(*) FILTER (entities > 1) AS ambiguous
FROM (SELECT doc_id, 1 AS words, entities FROM one UNION ALL SELECT doc_id, 2, entities FROM two) GROUP BY ALL""")
def longest_name(spark, sf):
    """Two-word names as well: a single word inside a longer declared name does not count."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)(?= (\p{L}+))"), F.lit(0))
    seconds = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)(?= (\p{L}+))"), F.lit(2))
    double = t.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("entity_id"), F.explode(F.array_distinct(F.zip_with(pairs, seconds, lambda a, b: F.concat_ws(" ", a, b)))).alias("surface")
    )
    every = t.alias_words(spark, sf).unionByName(double)
    surfaces = every.groupBy("surface").agg(F.count_distinct("entity_id").alias("entities"))
    found = dictionary.occurrences(t.table(spark, sf, "documents"), ["doc_id"], "text", surfaces)
    return found.groupBy("doc_id", "words").agg(F.count("*").alias("places"), F.count_if(F.col("entities") > 1).alias("ambiguous"))


#: Letters of four languages as ideographs, one for one: words become names without spaces.
_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一二三四五六七八九十百千万上下左右大中小山川田日月火"


@query("jn12_unspaced_names", "WITH " + t.ALIAS_SQL + r""",
nm AS (SELECT surface, count(*) AS entities FROM alias WHERE regexp_matches(surface, '^[a-z]{9,}$') GROUP BY 1),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 7), lambda k: substr(t, k, 9))) AS nine, unnest(range(1, length(t) - 7)) AS k FROM d),
h AS (SELECT g.doc_id, k, k + length(surface) AS stop, entities FROM g JOIN nm ON left(surface, 9) = nine JOIN d ON d.doc_id = g.doc_id AND substr(t, k, length(surface)) = surface),
x AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY k, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h)
SELECT doc_id, count(*) AS places, count(*) FILTER (entities > 1) AS ambiguous, min(k) - 1 AS first_start, max(stop) - 1 AS last_end
FROM x WHERE reach IS NULL OR stop > reach GROUP BY 1""")
def unspaced_names(spark, sf):
    """Long names in documents whose letters are written as ideographs without anything between them."""
    write = lambda c: F.translate(F.regexp_replace(F.lower(c), "[^a-z]", ""), _LATIN, _HAN)
    names = t.alias_words(spark, sf).filter(F.col("surface").rlike("^[a-z]{9,}$"))
    surfaces = names.groupBy(write("surface").alias("surface")).agg(F.count("*").alias("entities"))
    docs = t.table(spark, sf, "documents").select("doc_id", write("text").alias("text"))
    found = dictionary.occurrences(docs, ["doc_id"], "text", surfaces)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("places"), F.count_if(F.col("entities") > 1).alias("ambiguous"),
        F.min("start").cast("long").alias("first_start"), F.max("end").cast("long").alias("last_end"),
    )


@query("jn13_homophone_notes", "WITH " + r"""tk AS (SELECT DISTINCT page_id AS conv_id, w FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\p{L}{2,}')) AS w FROM pages))
SELECT c.conv_id, c.turn, string_agg(w, '/' ORDER BY w) AS hits FROM conversations c JOIN tk ON tk.conv_id = c.conv_id WHERE contains(lower(c.text), lower(w)) AND NOT contains(c.text, w) GROUP BY 1, 2""")
def homophone_notes(spark, sf):
    """Lines that hold a title word's reading (lower case) but not its literal form."""
    words = t.table(spark, sf, "pages").select(
        F.col("page_id").alias("conv_id"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(r"(\p{L}{2,})"), F.lit(1)))).alias("w"),
    )
    lines = t.table(spark, sf, "conversations")
    hit = F.contains(F.lower("text"), F.lower("w")) & ~F.contains("text", "w")
    # One row per title word of the line's own work, so a list is bounded by its title.
    return lines.join(words, "conv_id").filter(hit).groupBy("conv_id", "turn").agg(
        F.array_join(F.array_sort(F.collect_list("w")), "/").alias("hits")
    )


_CTX = r"""
wd AS (SELECT owner_id, pos, ws, unnest(range(2, len(ws))) AS i FROM (SELECT owner_id, pos, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM observation WHERE status = 'ok') WHERE len(ws) > 2),
tri AS (SELECT owner_id, pos, ws[i - 1] AS l, ws[i] AS m, ws[i + 1] AS r FROM wd),
uq AS (SELECT owner_id, pos, l, r, min(m) AS m FROM tri GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
nm AS (SELECT surface, min(entity_id) AS entity FROM alias GROUP BY 1),
k AS (SELECT u.*, n.entity FROM uq u JOIN nm n ON n.surface = u.m)"""


@query("jn15_competing_names", "WITH " + t.OBSERVATION_SQL + ", " + t.ALIAS_SQL + "," + _CTX + """
SELECT owner_id, l, r, count(*) AS readings, count(DISTINCT entity) AS entities, min(m) AS first_name FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT entity) > 1""")
def competing_names(spark, sf):
    """Places, fixed by a unique left and right word, where readings of one window name different entities."""
    names = t.alias_words(spark, sf).groupBy("surface").agg(F.min("entity_id").alias("entity"))
    found = dictionary.occurrences(t.observation(spark, sf).filter("status = 'ok'"), ["owner_id", "pos"], "text", names).filter("alone")
    named = found.select("owner_id", F.col("left").alias("l"), F.col("right").alias("r"), F.col("surface").alias("m"), "entity")
    per = named.groupBy("owner_id", "l", "r", "entity").agg(F.count("*").alias("c"), F.min("m").alias("m"))
    return per.groupBy("owner_id", "l", "r").agg(
        F.sum("c").alias("readings"), F.count("*").alias("entities"), F.min("m").alias("first_name")
    ).filter("entities > 1")


@query("jn16_paired_arms", "WITH " + t.VOTE_SQL + """
SELECT line % 50 AS bucket, count(*) AS pairs, count(*) FILTER (n <> q) AS changed, count(*) FILTER (line % 10 = 0 AND n <> '') AS control_violations FROM vote GROUP BY 1""")
def paired_arms(spark, sf):
    """Two arms per pair: changed pairs and controls that should have stayed silent."""
    arms = t.vote(spark, sf)
    a = arms.select("line", F.col("n").alias("text_a"))
    b = arms.select("line", F.col("q").alias("text_b"))
    return a.join(b, "line").groupBy((F.col("line") % 50).alias("bucket")).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("text_a") != F.col("text_b")).alias("changed"),
        F.count_if((F.col("line") % 10 == 0) & (F.col("text_a") != "")).alias("control_violations"),
    )


@query("jn17_before_after", """SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' ELSE 'changed' END AS kind FROM
(SELECT doc_id, text FROM documents WHERE lang <> 'de') b FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' ' ELSE text END AS text FROM documents WHERE n_chars >= 300) a ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text""")
def before_after(spark, sf):
    docs = t.table(spark, sf, "documents")
    before = docs.filter("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("was"))
    after = docs.filter("n_chars >= 300").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 4 = 0 THEN text || ' ' ELSE text END"), 256).alias("now"))
    both = before.join(after, "doc_id", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("doc_id", F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("changed").alias("kind"))


@query("jn19_unattempted", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unattempted(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id").join(t.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("agg13_shared_bigrams", "WITH " + t.PAIR_SQL + """,
s AS (SELECT episode_id, cue_id, substr(source, i, 2) AS g, count(*) AS n FROM pair, unnest(range(1, length(source))) AS x(i) GROUP BY 1, 2, 3),
d AS (SELECT episode_id, cue_id, substr(target, i, 2) AS g, count(*) AS n FROM pair, unnest(range(1, length(target))) AS x(i) GROUP BY 1, 2, 3)
SELECT episode_id, cue_id, CAST(sum(least(s.n, d.n)) AS BIGINT) AS shared FROM s JOIN d USING (episode_id, cue_id, g) GROUP BY 1, 2""")
def shared_bigrams(spark, sf):
    """Multiset intersection with one shuffle: both sides counted under one key."""
    pairs = t.pair(spark, sf)
    side = lambda c, s: pairs.select("episode_id", "cue_id", F.lit(s).alias("a"), F.explode(align.bigram_list(F.col(c))).alias("g"))
    grams = side("source", 1).unionByName(side("target", 0))
    per = grams.groupBy("episode_id", "cue_id", "g").agg(F.sum("a").alias("n"), F.sum(1 - F.col("a")).alias("m"))
    return per.groupBy("episode_id", "cue_id").agg(F.sum(F.least("n", "m")).alias("shared")).filter("shared > 0")
