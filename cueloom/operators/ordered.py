"""Ordered computation inside keys of any size.

``Window.partitionBy(key)`` puts a whole key in one task.  Here each key is first cut into
ordered *blocks*; a block is what one task sorts.  Running values cross blocks through a
summary with one row per (key, block), so a key holding a third of all rows is spread over
many tasks and the result is still exact.

Ways to cut blocks:

* ``dense_blocks``: the order column is a unique integer, so ``id div width`` bounds a block
  by ``width`` rows.  No extra job.
* ``key_blocks``: the same, but keys of few rows stay whole.
* ``range_blocks``: any order columns.  Rows are range-partitioned on (keys, order), the
  partition number is the block, and the table is pinned so that the number cannot change
  when a lost task is run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cueloom.shared import pin

BLOCK = "_block"
WIDTH = 32768
State = list | None


def dense_blocks(df: DataFrame, position: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn(BLOCK, F.expr(f"`{position}` div {width}"))


def key_blocks(df: DataFrame, keys: Sequence[str], position: str, width: int = WIDTH) -> DataFrame:
    """``dense_blocks`` for keys whose rows lie far apart: only a key of more than ``width`` rows is cut, into
    stretches of its own positions that hold ``width`` rows on average.  Blocks then are in proportion to rows,
    not to keys times blocks."""
    sized = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    span = f"greatest({width}L, (_hi - _lo) div ((_n + {width - 1}) div {width}) + 1)"
    wide = sized.filter(f"_n > {width}").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.expr(span).alias("_span"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    block = F.when(F.col("_span").isNull(), 0).otherwise(F.expr(f"`{position}` div _span")).cast("bigint")
    return df.join(wide, same, "left").select(*df.columns, block.alias(BLOCK))


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``order`` must end in a column that makes (keys, order) unique."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    return pin(cut.withColumn(BLOCK, F.spark_partition_id().cast("bigint")), "blocks")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    before: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
    fill: Mapping[str, Column] | None = None,
    block: str = BLOCK,
) -> DataFrame:
    """Add running columns that cross block edges.

    ``before``: sum over all earlier rows (0 on the first); ``peak``: maximum over all earlier
    rows; ``lag`` / ``lead``: value on the neighbouring row; ``fill``: last non-null value up
    to and including this row.
    """
    before, lag, lead = before or {}, lag or {}, lead or {}
    peak, fill = peak or {}, fill or {}
    group = [*keys, block]
    at = F.struct(*order)
    work = df.withColumns(
        {f"_v_{n}": e for n, e in {**before, **lag, **lead, **peak, **fill}.items()}
    )
    lag_row = F.struct(*[F.col(f"_v_{n}").alias(n) for n in lag]) if lag else None
    lead_row = F.struct(*[F.col(f"_v_{n}").alias(n) for n in lead]) if lead else None

    parts = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in before]
    parts += [F.max(f"_v_{n}").alias(f"_s_{n}") for n in peak]
    parts += [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_s_{n}") for n in fill
    ]
    if lag:
        parts.append(F.max_by(lag_row, at).alias("_last"))
    if lead:
        parts.append(F.min_by(lead_row, at).alias("_first"))
    summary = work.groupBy(*group).agg(*parts)

    across = Window.partitionBy(*keys).orderBy(block)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in before]
    carry += [F.max(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in peak]
    carry += [F.last(f"_s_{n}", True).over(earlier).alias(f"_c_{n}") for n in fill]
    if lag:
        carry.append(F.lag("_last").over(across).alias("_c_lag"))
    if lead:
        carry.append(F.lead("_first").over(across).alias("_c_lead"))
    rows = work.join(summary.select(*group, *carry), group)

    inside = Window.partitionBy(*group).orderBy(*order)
    inside_earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    inside_upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out: dict[str, Column] = {}
    for n in before:
        own = F.coalesce(F.sum(f"_v_{n}").over(inside_earlier), F.lit(0))
        out[n] = (own + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).cast("bigint")
    for n in peak:
        out[n] = F.greatest(F.max(f"_v_{n}").over(inside_earlier), F.col(f"_c_{n}"))
    for n in fill:
        out[n] = F.coalesce(F.last(f"_v_{n}", True).over(inside_upto), F.col(f"_c_{n}"))
    if lag:
        rows = rows.withColumn("_lag", F.coalesce(F.lag(lag_row).over(inside), "_c_lag"))
        out.update({n: F.col(f"_lag.{n}") for n in lag})
    if lead:
        rows = rows.withColumn("_lead", F.coalesce(F.lead(lead_row).over(inside), "_c_lead"))
        out.update({n: F.col(f"_lead.{n}") for n in lead})
    keep = [c for c in df.columns if c not in out]
    return rows.select(*keep, *[e.alias(n) for n, e in out.items()])


def dense_rank_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based row number inside ``keys`` for an order without a dense integer column."""
    cut = range_blocks(df, keys, order)
    return scan(cut, keys, order, before={out: F.lit(1)}).withColumn(out, F.col(out) + 1).drop(BLOCK)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    begins: Callable[[Column, Column], Column],
    *,
    out: str = "island",
    block: str = BLOCK,
) -> DataFrame:
    """Number runs of rows; ``begins(previous, current)`` is true where a run opens."""
    group = [*keys, block]
    inside = Window.partitionBy(*group).orderBy(*order)
    at = F.struct(*order)
    row = F.struct(*columns)
    local = df.withColumns({"_row": row, "_prev": F.lag(row).over(inside)})
    local = local.withColumn(
        "_open",
        F.when(F.col("_prev").isNotNull() & begins(F.col("_prev"), F.col("_row")), 1).otherwise(0),
    )
    local = local.withColumn("_run", F.sum("_open").over(inside))
    summary = local.groupBy(*group).agg(
        F.sum("_open").alias("_n"),
        F.min_by("_row", at).alias("_first"),
        F.max_by("_row", at).alias("_last"),
    )
    across = Window.partitionBy(*keys).orderBy(block)
    carry = summary.withColumn("_before", F.lag("_last").over(across))
    carry = carry.withColumn(
        "_opens",
        F.when(F.col("_before").isNull() | begins(F.col("_before"), F.col("_first")), 1).otherwise(0),
    )
    carry = carry.withColumn("_base", F.sum(F.col("_n") + F.col("_opens")).over(across) - F.col("_n"))
    rows = local.join(carry.select(*group, "_base"), group)
    return rows.select(*df.columns, (F.col("_base") + F.col("_run")).cast("bigint").alias(out))


def with_halo(
    df: DataFrame, position: str, before: int, after: int, width: int = WIDTH
) -> DataFrame:
    """Copy edge rows into the neighbouring block so bounded frames see past the edge.

    ``position`` must be dense inside its key.  ``_core`` marks the row's own block; compute
    windows over (keys, block) and then keep ``_core`` rows.
    """
    own = F.expr(f"`{position}` div {width}")
    offset = F.pmod(F.col(position), F.lit(width))
    spots = F.array_compact(
        F.array(
            own,
            F.when(offset >= width - before, own + 1),
            F.when(offset < after, own - 1),
        )
    )
    copies = df.withColumns({"_own": own, BLOCK: F.explode(spots)})
    return copies.withColumn("_core", F.col("_own") == F.col(BLOCK)).drop("_own")


def fold_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    advance: Callable[[State, tuple], tuple[State, list[tuple]]],
    schema: T.StructType,
    keep: Sequence[str],
    *,
    block: str = BLOCK,
    states: Sequence[State] | None = None,
) -> DataFrame:
    """Exact left-to-right fold over keys of any size, many blocks at a time.

    ``advance(state, row)`` gets the ``columns`` of one row and the state after the row before
    (``None`` at the start of a key); it returns the next state, a JSON value, and the rows it
    emits.  Rows are sorted by Spark and streamed, so a task holds one batch and one state.

    Keys inside one block are done in one pass.  For a key over many blocks two passes find, for every
    block, the states its rows could leave behind, wherever a group opened, and then the exit of the
    block after it for each of them.  These tables of entry and exit are composed by pointer doubling, so the
    true entry of every block is known after a number of rounds logarithmic in the blocks of a key, whether or not
    the rule forgets.  The states of a block are as many as there are different groups open at its end.  ``advance(None, row)`` must
    give the state of a group opened by ``row``.  A rule with few states lists them in ``states`` instead,
    and every block is asked for the exit of each.
    """
    group, n_out = [*keys, block], len(schema.fields) - len(keep)
    names = [f.name for f in schema.fields]
    needed = list(dict.fromkeys([*keep, *group, *order, *columns]))
    rows = df.select(*needed)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of every block from its true entry."""
        at: tuple | None = None
        state: State = None
        for part in parts:
            made: list[list] = [[] for _ in range(n_out)]
            spots: list[int] = []
            heads = zip(*[part[c].tolist() for c in group])
            values = zip(*[part[c].tolist() for c in columns])
            for i, (here, row, entry) in enumerate(zip(heads, values, part["_entry"].tolist())):
                if here != at:
                    at, state = here, json.loads(entry) if isinstance(entry, str) else None
                state, out = advance(state, row)
                for values_out in out:
                    spots.append(i)
                    for column, value in zip(made, values_out):
                        column.append(value)
            frame = part[list(keep)].iloc[spots].reset_index(drop=True)
            for name, column in zip(names[len(keep):], made):
                frame[name] = column
            yield frame

    def through(parts: Iterator[pd.DataFrame], fresh: bool) -> Iterator[pd.DataFrame]:
        """Exits of every block: from each of its ``_entries``, and where ``fresh`` from a group opened at any row.

        States that have become equal are advanced once.
        """
        at: tuple | None = None
        live: dict[str, list[str | None]] = {}

        def left() -> list[tuple]:
            return [(*at, entry, state) for state, entries in live.items() for entry in (entries or [None])]

        for part in parts:
            done: list[tuple] = []
            heads = zip(*[part[c].tolist() for c in group])
            values = zip(*[part[c].tolist() for c in columns])
            for here, row, entries in zip(heads, values, part["_entries"]):
                if here != at:
                    done += left() if at is not None else []
                    at, live = here, {} if entries is None else {entry: [entry] for entry in entries}
                after: dict[str, list[str | None]] = {}
                for state, of in live.items():
                    after.setdefault(json.dumps(advance(json.loads(state), row)[0]), []).extend(of)
                if fresh:
                    after.setdefault(json.dumps(advance(None, row)[0]), [])
                live = after
            yield pd.DataFrame(done, columns=[*group, "_from", "_to"])
        if at is not None:
            yield pd.DataFrame(left(), columns=[*group, "_from", "_to"])

    def laid_out(ready: DataFrame) -> DataFrame:
        return ready.repartition(*group).sortWithinPartitions(*group, *order)

    spans = rows.groupBy(*keys).agg(F.min(block).alias("_a"), F.max(block).alias("_b")).filter("_a < _b")
    if spans.isEmpty():
        ready = rows.withColumn("_entry", F.lit(None).cast("string"))
    else:
        # Only keys that span several blocks take part in the exchange of states.
        many = rows.join(spans.select(*keys), list(keys), "left_semi") if keys else rows
        fields = {f.name: f for f in df.schema.fields}
        text = T.StringType()
        schema_of = T.StructType([*(fields[c] for c in group), T.StructField("_from", text), T.StructField("_to", text)])

        def exits(entries: DataFrame | None) -> DataFrame:
            if entries is None:
                own = many.withColumn("_entries", F.lit(None).cast("array<string>"))
                return laid_out(own).mapInPandas(lambda parts: through(parts, True), schema_of)
            own = many.join(entries.groupBy(*group).agg(F.collect_set("_from").alias("_entries")), group)
            return laid_out(own).mapInPandas(lambda parts: through(parts, False), schema_of)

        given = None if states is None else [json.dumps(state) for state in states]
        ready = rows.join(_entries(many, keys, block, exits, given), group, "left")
    return laid_out(ready).mapInPandas(walk, schema)


def _entries(
    many: DataFrame, keys: Sequence[str], block: str, exits: Callable[[DataFrame | None], DataFrame], states: list[str] | None,
) -> DataFrame:
    """(keys, block, _entry): the true entry of every block.

    ``exits`` gives, for (keys, block, _from), the exits ``_to`` of those entries, and for ``None`` the exits of
    groups opened inside.
    """
    group = [*keys, block]
    across = Window.partitionBy(*keys).orderBy(block)
    numbered = many.select(*group).distinct().select(*group, F.row_number().over(across).alias("_k"))
    blocks = pin(numbered.withColumn("_next", F.lead(block).over(across)), "blocks")
    start = blocks.filter("_k = 1").select(*group, F.lit("null").alias("_from"))

    def after(table: DataFrame) -> DataFrame:
        """Exits as entries of the next block."""
        return table.join(blocks.filter("_next IS NOT NULL").select(*group, "_next"), group).select(
            *keys, F.col("_next").alias(block), F.col("_to").alias("_from")
        )

    if states is None:
        first = after(exits(None))
    else:
        first = blocks.filter("_k > 1").select(*group, F.explode(F.array(*map(F.lit, states))).alias("_from"))
    asked = pin(first.unionByName(start).distinct(), "entries")
    table = known = None
    while True:
        made = pin(exits(asked), "exits")
        table = made if table is None else table.unionByName(made)
        known = asked if known is None else known.unionByName(asked)
        # A state that passed a whole block without opening a group may not have been asked for yet.
        asked = pin(after(made).distinct().join(known, [*group, "_from"], "left_anti"), "entries")
        if asked.isEmpty():
            break
    place = blocks.select(*group, "_k")
    jump = pin(table.join(place, group).select(*keys, F.col("_k").alias("_i"), F.col("_from"), (F.col("_k") + 1).alias("_j"), "_to"), "pointers")
    reached = start.join(place, group).select(*keys, F.col("_k").alias("_i"), "_from")
    most, step = blocks.agg(F.max("_k")).first()[0], 1
    while step < most:
        on = [*keys, "_i", "_from"]
        moved = reached.join(jump, on).select(*keys, F.col("_j").alias("_i"), F.col("_to").alias("_from"))
        reached = pin(reached.unionByName(moved).join(place.select(*keys, F.col("_k").alias("_i")), [*keys, "_i"], "left_semi"), "reached")
        step *= 2
        if step < most:
            far = jump.select(*keys, F.col("_i").alias("_j"), F.col("_from").alias("_to"), F.col("_j").alias("_j2"), F.col("_to").alias("_to2"))
            jump = pin(jump.join(far, [*keys, "_j", "_to"]).select(*keys, "_i", "_from", F.col("_j2").alias("_j"), F.col("_to2").alias("_to")), "pointers")
    return reached.join(place.withColumnRenamed("_k", "_i"), [*keys, "_i"]).select(*group, F.col("_from").alias("_entry"))
