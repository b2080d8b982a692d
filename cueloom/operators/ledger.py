"""Edits as transactions over tables: prepare, apply, commit in groups, roll back, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cueloom.functions import text as tx
from cueloom.operators import dictionary, ordered


def prepare(edits: DataFrame) -> DataFrame:
    """Bind each edit to its base or name the first rule it breaks."""
    target, old, new = F.col("target"), F.col("old"), F.col("new")
    rejection = F.coalesce(
        F.when(F.col("base_hash") != F.sha2(target, 256), "stale_base"),
        F.when(old == "", "empty_span"),
        F.when(~tx.unique_span(target, old), "target_span_not_unique"),
        tx.span_rejection(target, old),
        F.when(F.length(new) > F.greatest(F.lit(64), F.length(old) * 2), "replacement_too_long"),
    )
    after = F.when(rejection.isNull(), F.replace(target, old, new)).otherwise(target)
    return edits.withColumns({"rejection": rejection, "after": after, "valid": rejection.isNull()})


def apply_batch(base: DataFrame, transactions: DataFrame, batch: Sequence[str], row: Sequence[str], text: str) -> DataFrame:
    """All or nothing per batch: one invalid or doubled transaction rejects its batch.

    Batches are judged by an aggregate that combines map-side; accepted edits meet the base
    by row key, so a batch holding a third of all rows is spread like its rows.
    """
    per_row = transactions.groupBy(*batch, *row).agg(
        F.count("*").alias("_n"), F.bool_and("valid").alias("_ok"), F.min("after").alias("_after")
    )
    refused = per_row.filter("_n > 1 OR NOT _ok").select(*batch).distinct()
    kept = per_row.join(refused, list(batch), "left_anti").select(*batch, *row, "_after")
    return base.join(kept, [*batch, *row], "left").withColumns(
        {"applied": F.col("_after").isNotNull(), text: F.coalesce("_after", text)}
    ).drop("_after")


def apply_in_order(text: Column, edits: Column) -> Column:
    """Span edits one after another; an edit whose span is not unique by then is refused."""
    start = F.struct(text.alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def one(acc: Column, edit: Column) -> Column:
        fits = (edit["old"] != "") & (tx.occurrences(acc["text"], edit["old"]) == 1)
        return F.struct(
            F.when(fits, F.replace(acc["text"], edit["old"], edit["new"])).otherwise(acc["text"]).alias("text"),
            (acc["applied"] + F.when(fits, 1).otherwise(0)).alias("applied"),
            (acc["refused"] + F.when(fits, 0).otherwise(1)).alias("refused"),
        )

    return F.aggregate(edits, start, one)


def neighbours_ok(verdicts: DataFrame, keys: Sequence[str], number: str, ok: str) -> DataFrame:
    """True where a row and both neighbours passed: each verdict is sent to three rows."""
    spread = verdicts.select(*keys, F.col(ok).alias("_ok"), F.explode(F.array(F.col(number) - 1, F.col(number), F.col(number) + 1)).alias(number))
    return spread.groupBy(*keys, number).agg(F.bool_and("_ok").alias("around_ok"))


def final_status(source: Column, target: Column) -> Column:
    """Open source questions outrank a target verdict, except that unchecked stays unchecked."""
    open_source = source.isin("unresolved", "unchecked")
    return F.when(open_source & (target != "unchecked"), source).otherwise(target)


def mask_names(df: DataFrame, key: str, text: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace declared names by numbered markers: (key, marked) and (key, marker, surface_text).

    ``names`` has one row per ``surface``.  A text is masked in its own row.
    """
    cut = dictionary.marked(df, text, names, [key])
    values = cut.select(key, F.inline(F.arrays_zip(F.col("cut.markers").alias("marker"), F.col("cut.surfaces").alias("surface_text"))))
    return cut.select(key, F.col("cut.marked").alias("marked")), values


def restore_names(marked: DataFrame, values: DataFrame, key: str, text: str) -> DataFrame:
    """Markers back to names; ``exact`` is false unless every expected marker stands in the text exactly once
    and no other does.  A text's markers are gathered in one row, as they stand in one text."""
    own = values.groupBy(key).agg(F.collect_list("marker").alias("_markers"), F.collect_list("surface_text").alias("_surfaces"))
    both = marked.join(own, key, "left")
    back = dictionary.restored()(F.col(text), F.col("_markers"), F.col("_surfaces"))
    return both.withColumn("_back", back).select(key, "_back.restored", "_back.exact", "_back.markers")


#: (state, event) -> state of an issue; what is not listed changes nothing.  ``resolved`` needs a repair before it.
LIFECYCLE = {
    ("not_flagged", "issue"): "diagnosed",
    ("diagnosed", "persists"): "persists", ("diagnosed", "unsupported"): "unsupported",
    ("unsupported", "persists"): "persists",
    ("persists", "unsupported"): "unsupported",
    ("persists", "repair"): "repaired",
    ("repaired", "resolved"): "resolved", ("repaired", "persists"): "persists", ("repaired", "unsupported"): "unsupported",
    ("resolved", "persists"): "persists", ("resolved", "unsupported"): "unsupported",
}


def issue_states(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], event: str, max_repairs: int = 2,
    table: dict[tuple[str, str], str] | None = None, start: str = "not_flagged", repair: str = "repair",
) -> DataFrame:
    """State of an issue after every event: ``state``, ``attempts`` and ``changed``.

    ``log`` carries blocks.  A repair counts as an attempt and is refused once ``max_repairs`` were made.  As the
    states are few, blocks are composed through a table of all of them.
    """
    table = LIFECYCLE if table is None else table

    def advance(state: ordered.State, row: tuple) -> tuple[ordered.State, list[tuple]]:
        now, attempts = [start, 0] if state is None else state
        after = table.get((now, row[0]), now)
        if row[0] == repair and after != now:
            if attempts >= max_repairs:
                after = now
            else:
                attempts += 1
        return [after, attempts], [(after, attempts, int(after != now))]

    fields = {f.name: f for f in log.schema.fields}
    kept = [*keys, *order]
    schema = T.StructType([fields[c] for c in kept] + [
        T.StructField("state", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("changed", T.LongType()),
    ])
    names = sorted({start, *(a for a, _ in table), *table.values()})
    states = [[name, n] for name in names for n in range(max_repairs + 1)]
    return ordered.fold_rows(log, keys, order, [event], advance, schema, kept, states=states)


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Newest value per key from an append-only log."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
