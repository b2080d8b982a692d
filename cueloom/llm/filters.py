"""What each filter removes, for every order of the filters, from relations of failing ids.

A row's id is a digest of its document id and its text.  One table of failing ids is written per
filter.  ``left`` holds (prefix, id) for every set of filters that could stand before another and
every failing document that survives it: it starts with the empty prefix and grows filter by filter,
``left`` united with ``left`` anti-joined by that filter's ids.  A document that fails m of n filters
survives 2^(n-m) prefixes, so at n = 5 a document is listed 16 times at most, and those failing
nothing never.  ``left`` semi-joined by a filter's ids is what that filter removes after each prefix.
Orders are then read off the counts: every step of an order is a prefix and a filter.

All joins are on the id, which is as good as unique, so none is skewed; equal texts meet on their digest
in one join only, against one row per digest, which Spark's skew handling can split.

Defined cases: a null text is an empty one, a null part the empty string; rows with the same id and text
count each; a null id is smaller than nothing and nothing is smaller than it, so such rows never fail
as copies, and have no labels; of several label rows of an id any one counts; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.shared import pin

SPACES = " \t\n\x0b\x0c\r"
#: All orders of more filters than these would be too many rows.
MOST = 6


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _ids(base: DataFrame, names: list[str], copies: str | None) -> dict[str, DataFrame]:
    """One written table of failing ids per filter."""
    made = {name: base.filter(F.array_contains("fails", name)) for name in names if name != copies}
    if copies is not None:
        groups = base.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first")
        made[copies] = base.join(groups.select("digest", "first"), "digest").filter("doc_id > first")
    return {name: pin(made[name].select("key").distinct(), "failing") for name in names}


def _steps(names: list[str]) -> Column:
    """The literal rows (filter_order, step, at, before): filter ``at`` after the prefix set ``before``."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, at in enumerate(order, 1):
            rows.append({"filter_order": "".join(names[i] for i in order), "step": step, "at": at, "before": before})
            before |= 1 << at
    kind = "array<struct<filter_order: string, step: int, at: int, before: int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def audit_filters(
    docs: DataFrame, filters: dict[str, Column], labels: DataFrame, part: str = "source", copies: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per part, order of the filters and step.

    ``filters`` maps a name to the condition under which a row fails, over the columns ``text`` (never
    null) and ``words``; ``copies`` names one more filter, which fails every text that a smaller id has
    too.  ``labels`` has doc_id, quality and toxic.  Columns: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    names = [*filters, *([copies] if copies is not None else [])]
    if not 0 < len(set(names)) == len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters of different names")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"),
    )
    split = read.select("*", word_list(F.col("text")).alias("words"))
    judged = split.select("doc_id", "part", F.md5("text").alias("digest"), F.array_compact(F.array(
        *(F.when(condition, F.lit(name)) for name, condition in filters.items()), F.lit(None).cast("string"),
    )).alias("fails"))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "digest"))
    base = pin(judged.select("*", F.unhex(key).alias("key")), "judged")
    ids = _ids(base, names, copies)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    ).filter("good = 1 OR toxic = 1")
    anything = ids[names[0]]
    for name in names[1:]:
        anything = anything.union(ids[name])
    failing = base.select("doc_id", "part", "key").join(anything.distinct(), "key", "left_semi").join(marks, "doc_id", "left")
    left = failing.select(
        F.lit(0).alias("before"), "key", "part",
        F.coalesce("good", F.lit(0)).cast("byte").alias("good"), F.coalesce("toxic", F.lit(0)).cast("byte").alias("toxic"),
    )
    left = pin(left, "prefixes")
    for at, name in enumerate(names):
        past = left.join(ids[name], "key", "left_anti").withColumn("before", F.col("before").bitwiseOR(F.lit(1 << at)))
        left = pin(left.unionByName(past), "prefixes")

    def cells(rows: DataFrame, kind: Column) -> DataFrame:
        n = F.count("*").alias("n")
        good, toxic = (F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic"))
        return rows.groupBy("part", kind.alias("cell")).agg(n, good, toxic)

    alive = cells(left, F.concat_ws(" ", F.lit("alive"), "before"))
    removed = [
        cells(left.join(ids[name], "key", "left_semi"), F.concat_ws(" ", F.lit("removed"), "before", F.lit(at)))
        for at, name in enumerate(names)
    ]
    total = base.groupBy("part").agg(F.lit("all").alias("cell"), F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    every = total.select("part", "cell", "n", "good", "toxic")
    for one in (alive, *removed):
        every = every.unionByName(one)
    # At most 1 + 2^n + n * 2^(n-1) cells a part.
    counts = every.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("n", "good", "toxic")))).alias("cells"))
    return _read_off(counts, names)


def _read_off(counts: DataFrame, names: list[str]) -> DataFrame:
    n, full = len(names), (1 << len(names)) - 1

    def cell(field: str, *name: Column) -> Column:
        return F.coalesce(F.try_element_at("cells", F.concat_ws(" ", *name))[field], F.lit(0).cast("long"))

    def removed(before: Column, at: Column, field: str = "n") -> Column:
        return cell(field, F.lit("removed"), before, at)

    weight = [factorial(bin(s).count("1")) * factorial(max(n - 1 - bin(s).count("1"), 0)) for s in range(full + 1)]
    steps = counts.select("part", "cells", F.inline(_steps(names)))
    bit = F.expr("shiftleft(1, at)")
    number = steps.select(
        "part", "filter_order", "step", "at",
        (cell("n", F.lit("all")) - cell("n", F.lit("alive"), F.lit(0)) + cell("n", F.lit("alive"), F.col("before").bitwiseOR(bit))).alias("kept"),
        removed(F.col("before"), F.col("at")).alias("removed"),
        (removed(F.lit(0), F.col("at")) - removed(F.col("before"), F.col("at"))).alias("redundant"),
        removed(F.lit(full) - bit, F.col("at")).alias("unique_fails"),
        removed(F.col("before"), F.col("at"), "good").alias("good_lost"),
        removed(F.col("before"), F.col("at"), "toxic").alias("toxic_lost"),
        sum(
            (removed(F.lit(s), F.col("at")) * weight[s] for s in range(full + 1) if s != full), F.lit(0).cast("long")
        ).alias("shapley"),
    )
    return number.drop("at")
