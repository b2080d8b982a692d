"""Parsing of numbered answers, comment lists and JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.functions import text as tx


def numbered_lines(df: DataFrame, ids: Sequence[str], answer: str) -> DataFrame:
    """One row per ``[N] text`` line, in line order; a number beyond 64 bits is null, which is foreign."""
    lines = df.select(*ids, F.posexplode(F.split(answer, r"\r\n|\n|\r")).alias("line_no", "_line"))
    bare = tx.strip(F.col("_line"))
    shape = r"(?s)^\[(\d+)\]\s*(.+)$"
    return lines.filter(bare.rlike(shape)).select(
        *ids, "line_no", F.regexp_extract(bare, shape, 1).try_cast("bigint").alias("number"),
        F.regexp_extract(bare, shape, 2).alias("value"),
    )


def parse_answers(df: DataFrame, ids: Sequence[str], answer: str, expected: str) -> DataFrame:
    """Strict reading: a foreign id voids the answer, a repeated id is dropped, the rest kept."""
    lines = numbered_lines(df, ids, answer)
    scope = df.select(*ids, expected)
    seen = lines.join(scope, list(ids)).withColumn(
        "_ok", F.coalesce(F.col("number").between(1, F.col(expected)), F.lit(False))
    )
    per = seen.groupBy(*ids, "number").agg(
        F.count("*").alias("_n"), F.min("value").alias("value"), F.bool_and("_ok").alias("_ok")
    )
    void = per.groupBy(*ids).agg(F.bool_and("_ok").alias("_clean"))
    return per.join(void.filter("_clean"), list(ids), "left_semi").filter("_n = 1").select(*ids, "number", "value")


def last_answers(df: DataFrame, ids: Sequence[str], answer: str, expected: str) -> DataFrame:
    """Lenient reading: the last line of an id wins; without any mark, lines count by position."""
    lines = numbered_lines(df, ids, answer)
    marked = lines.join(df.select(*ids, expected), list(ids)).filter(F.col("number").between(1, F.col(expected)))
    last = marked.groupBy(*ids, "number").agg(F.max_by("value", "line_no").alias("value"))
    plain = F.filter(F.transform(F.split(answer, r"\r\n|\n|\r"), tx.strip), lambda s: s != "")
    bare = df.join(lines.select(*ids).distinct(), list(ids), "left_anti")
    placed = bare.select(*ids, expected, F.posexplode(plain).alias("_p", "value")).select(
        *ids, expected, (F.col("_p") + 1).cast("bigint").alias("number"), "value"
    ).filter(F.col("number") <= F.col(expected)).drop(expected)
    found = last.unionByName(placed)
    wanted = df.select(*ids, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(expected))).alias("number"))
    return wanted.join(found, [*ids, "number"], "left").withColumns(
        {"missing": F.col("value").isNull(), "value": F.coalesce("value", F.lit(""))}
    )


# Shapes of critic lines and of "nothing to report".
COMMENT = r"^(?:(?:行号\s*[:：])|行|第)?\s*\[?#?\s*(\d+)\s*\]?\s*(?:行)?\s*[:：]\s*(.+)$"
BRACKET = r"^\[\s*(\d+)\s*\]\s*(.+)$"
BULLET = r"^\s*(?:[-*•·]|\d+\.)\s+"
NO_ITEMS = ("无", "无。", "（无）", "(无)", "none", "None", "无可疑行", "没有")


def comments(df: DataFrame, ids: Sequence[str], answer: str, max_line: str, limit: int = 160) -> DataFrame:
    """``line: note`` items of a critic answer; ``in_range`` is false for foreign line numbers.

    Lines are read inside their array, step by step: as columns, the steps would be put into one another and every
    pattern tried again wherever its result is used.
    """
    def shaped(s: Column, i: Column) -> Column:
        return F.struct(i.alias("at"), tx.strip(F.regexp_replace(s, BULLET, "")).alias("item"))

    def read(x: Column) -> Column:
        part = lambda i: F.when(x["colon"], F.regexp_extract(x["item"], COMMENT, i)).otherwise(F.regexp_extract(x["item"], BRACKET, i))
        return F.struct(x["at"].alias("at"), part(1).try_cast("bigint").alias("line"), tx.strip(part(2)).alias("note"))

    items = F.filter(F.transform(F.split(answer, r"\r\n|\n|\r"), shaped), lambda x: (x["item"] != "") & ~x["item"].isin(*NO_ITEMS))
    seen = F.transform(items, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item"), x["item"].rlike(COMMENT).alias("colon")))
    notes = F.transform(F.filter(seen, lambda x: x["colon"] | x["item"].rlike(BRACKET)), read)
    rows = df.select(*ids, max_line, F.inline(F.filter(notes, lambda x: x["note"] != "")))
    note = F.when(F.length("note") <= limit, F.col("note")).otherwise(F.concat(F.substring("note", 1, limit - 1), F.lit("…")))
    return rows.select(*ids, "at", "line", note.alias("note"), F.coalesce(F.col("line").between(1, F.col(max_line)), F.lit(False)).alias("in_range"))


def json_rejection(text: Column) -> Column:
    """Why a JSON text is refused as a strict object: shape, constants or repeated keys.

    Constants are looked for outside strings.  A key repeated in a nested object is refused by the
    parser itself, as malformed.
    """
    keys = F.json_object_keys(text)
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    return (
        F.when(bare.rlike(r"[:\[,]\s*-?(?:NaN|Infinity)\b"), "constant")
        .when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate_key")
        .when(F.try_parse_json(text).isNull(), "malformed")
        .when(~F.ltrim(text).startswith("{"), "not_object")
    )
