"""Half-open integer intervals: overlap, containment, union, nearest boundary.

Catalyst plans a bare inequality join as a nested loop.  Here both sides are put into time bins and joined on
(keys, level, bin).  Bins are nested: a level's are twice as wide as those of the level below, and an
interval belongs to the first level whose bins are as long as it is, where it touches two at most.  A pair meets
on the level of its longer interval; so an interval stands on its own level and on the longer ones that the
other side has, which makes a number of rows logarithmic in the longest interval, however long it is itself.
Of several common bins the one holding ``greatest(a.start, b.start)`` counts, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.operators import ordered


def bin_of(at: Column, width: int) -> Column:
    """Integer division towards minus infinity."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def spread(df: DataFrame, start: str, end: str, width: int, out: str = "_bin") -> DataFrame:
    """One row per bin an interval touches; an empty interval touches none."""
    bins = F.sequence(bin_of(F.col(start), width), bin_of(F.col(end) - 1, width))
    return df.filter(F.col(start) < F.col(end)).withColumn(out, F.explode(bins))


def level_of(start: str, end: str, width: int) -> Column:
    """Least level whose bins of ``width * 2^level`` are at least as long as the interval."""
    bins = F.expr(f"(`{end}` - `{start}` + {width} - 1) div {width}")
    return F.when(bins <= 1, 0).otherwise(F.length(F.bin(bins - 1))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels there are: fewer than the bits of a long."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _wide_bin(at: Column, width: int, level: Column) -> Column:
    wide = F.call_function("shiftleft", F.lit(width).cast("bigint"), level)
    return F.call_function("div", at - F.pmod(at, wide), wide)


def _on_levels(df: DataFrame, start: Column, last: Column, width: int, levels: Column) -> DataFrame:
    """One row per bin touched on each of ``levels``."""
    spots = F.flatten(F.transform(levels, lambda n: F.transform(
        F.sequence(_wide_bin(start, width, n), _wide_bin(last, width, n)), lambda b: F.struct(n.alias("_on"), b.alias("_bin"))
    )))
    return df.select("*", F.inline(spots))


def _wider(levels: list[int], own: Column, equal: bool) -> Column:
    found = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    return F.filter(found, lambda n: (n >= own) if equal else (n > own))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    left_span: tuple[str, str], right_span: tuple[str, str], width: int,
) -> DataFrame:
    """Pairs with ``l.start < r.end and r.start < l.end``; span columns need distinct names.

    ``width`` is about the length of the shorter intervals; pairs do not depend on it.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.filter(F.col(ls) < F.col(le)).withColumn("_level", level_of(ls, le, width))
    b = right.filter(F.col(rs) < F.col(re)).withColumn("_level", level_of(rs, re, width))
    of_a, of_b = _levels(a), _levels(b)
    own = F.array("_level")
    a = _on_levels(a, F.col(ls), F.col(le) - 1, width, F.array_union(own, _wider(of_b, F.col("_level"), True)))
    b = _on_levels(b, F.col(rs), F.col(re) - 1, width, F.array_union(own, _wider(of_a, F.col("_level"), False)))
    first = _wide_bin(F.greatest(F.col(ls), F.col(rs)), width, F.col("_on"))
    met = a.join(b.withColumnRenamed("_level", "_level_b"), [*keys, "_on", "_bin"])
    return met.filter(
        (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_on") == F.greatest("_level", "_level_b")) & (F.col("_bin") == first)
    ).drop("_on", "_bin", "_level", "_level_b")


def overlap_amount(ls: str, le: str, rs: str, re: str) -> Column:
    return F.least(F.col(le), F.col(re)) - F.greatest(F.col(ls), F.col(rs))


def covered(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ids: Sequence[str],
    left_span: tuple[str, str], right_span: tuple[str, str], out: str,
) -> DataFrame:
    """Length of each left interval covered by the disjoint right intervals (0 kept).

    No pairs are built.  With C(t) the covered length up to t, the answer is C(end) - C(start).
    Right starts and the two ends of every left interval are put in one order per key; a
    running sum of lengths and the last interval seen give C at each point.
    """
    (ls, le), (rs, re) = left_span, right_span
    keys, ids = list(keys), list(ids)
    none = F.lit(None).cast("bigint")
    starts = right.select(
        *keys, *[none.alias(c) for c in ids], F.col(rs).alias("_t"), F.lit(0).alias("_kind"), F.col(re).alias("_stop")
    )
    ends = left.select(*keys, *ids, F.inline(F.array(
        F.struct(F.col(ls).alias("_t"), F.lit(1).alias("_kind"), none.alias("_stop")),
        F.struct(F.col(le).alias("_t"), F.lit(2).alias("_kind"), none.alias("_stop")),
    )))
    order = ["_t", "_kind", *ids]
    cut = ordered.range_blocks(starts.unionByName(ends), keys, order)
    # An interval may still run at t, so what lies beyond t is taken off again.
    run = ordered.scan(
        cut, keys, order, before={"_sum": F.coalesce(F.col("_stop") - F.col("_t"), F.lit(0))}, fill={"_last": F.col("_stop")}
    ).filter("_kind > 0")
    upto = F.col("_sum") - F.greatest(F.lit(0), F.coalesce("_last", F.lit(0)) - F.col("_t"))
    found = run.groupBy(*keys, *ids).agg(
        F.sum(F.when(F.col("_kind") == 2, upto).otherwise(-upto)).cast("bigint").alias(out)
    )
    return left.join(found, [*keys, *ids])


def point_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, span: tuple[str, str], width: int
) -> DataFrame:
    """Pairs with ``start <= point < end``."""
    start, end = span
    b = spans.filter(F.col(start) < F.col(end)).withColumn("_level", level_of(start, end, width))
    levels = _levels(b)
    a = _on_levels(points, F.col(at), F.col(at), width, _wider(levels, F.lit(0), True))
    b = _on_levels(b, F.col(start), F.col(end) - 1, width, F.array("_level")).drop("_level")
    return a.join(b, [*keys, "_on", "_bin"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_on", "_bin")


def _openings(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """Rows that open a run of touching intervals, with the end of the run before them."""
    order = [start, tie]
    cut = ordered.range_blocks(df.select(*keys, start, end, tie), keys, order)
    peaks = ordered.scan(cut, keys, order, peak={"_prev_end": F.col(end)})
    opened = peaks.filter(F.col("_prev_end").isNull() | (F.col(start) > F.col("_prev_end")))
    return cut, opened.select(*keys, start, tie, "_prev_end", ordered.BLOCK)


def union_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Merge overlapping or touching intervals per key.

    A run ends at the running maximum the next opening sees, the last one at the key's maximum.
    """
    keys = list(keys)
    cut, opened = _openings(df, keys, start, end, tie)
    nexts = ordered.scan(opened, keys, [start, tie], lead={"_run_end": F.col("_prev_end")})
    tops = cut.groupBy(*keys).agg(F.max(end).alias("_top"))
    return nexts.join(tops, keys).select(*keys, start, F.coalesce("_run_end", "_top").alias(end))


def silence_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Gaps between merged intervals and their centres."""
    _, opened = _openings(df, list(keys), start, end, tie)
    return opened.filter("_prev_end IS NOT NULL").select(
        *keys, F.col("_prev_end").alias("gap_start"), F.col(start).alias("gap_end"),
        F.expr(f"(_prev_end + {start}) div 2").alias("centre"),
    )


def without_conflicts(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Drop both sides of every overlapping pair, without building the pairs.

    In start order a row overlaps an earlier one iff the running maximum end is beyond its
    start, and a later one iff the next start is before its end.
    """
    order = [start, tie]
    cut = ordered.range_blocks(df, keys, order)
    seen = ordered.scan(cut, keys, order, peak={"_peak": F.col(end)}, lead={"_next": F.col(start)})
    clash = (F.col("_peak") > F.col(start)) | (F.col("_next") < F.col(end))
    return seen.filter(~F.coalesce(clash, F.lit(False))).drop("_peak", "_next", ordered.BLOCK)


def nearest_boundary(
    probes: DataFrame, boundaries: DataFrame, keys: Sequence[str], ids: Sequence[str],
    target: str, bound: str, tolerance: int, allowed: Column | None = None, out: str = "snapped",
) -> DataFrame:
    """Closest boundary within tolerance; the smaller wins a tie; the target where none is near.

    Boundaries are distinct integers, so a bin of ``tolerance`` width holds at most
    ``tolerance`` of them whatever the skew.
    """
    width = tolerance + 1
    marks = boundaries.select(*keys, bound).distinct().withColumn("_bin", F.expr(f"{bound} div {width}"))
    spots = F.expr(f"sequence(({target} - {tolerance}) div {width}, ({target} + {tolerance}) div {width})")
    near = (
        probes.withColumn("_bin", F.explode(spots))
        .join(marks, [*keys, "_bin"])
        .withColumn("_d", F.abs(F.col(bound) - F.col(target)))
        .filter(f"_d <= {tolerance}")
    )
    if allowed is not None:
        near = near.filter(allowed)
    best = near.groupBy(*keys, *ids).agg(F.min(F.struct("_d", bound)).alias("_best"))
    return (
        probes.join(best, [*keys, *ids], "left")
        .withColumn(out, F.coalesce(F.col(f"_best.{bound}"), F.col(target)))
        .drop("_best")
    )
