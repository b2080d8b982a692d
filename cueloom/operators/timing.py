"""Display timing passes over ordered cues, in integer milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cueloom.functions import text as tx
from cueloom.operators import ordered
from cueloom.operators.segments import State, fold, number_groups
from cueloom.shared import pin

# Fixed values of the display rules.
GAP, ROOM, LEAD_OUT, MIN_CUE, MAX_CUE, CPS = 40, 200, 300, 800, 7000, 9
CHAR_FLOOR, QUANTUM, REPAIR_PER_CHAR = 60, 100, 150
FLASH = 400


def reading_need(text: Column) -> Column:
    return F.greatest(F.lit(MIN_CUE), F.floor(F.length(tx.convention(text)) * 1000 / CPS)).cast("bigint")


def finalize(cues: DataFrame, keys: Sequence[str], order: Sequence[str], media_end: str | None = None) -> DataFrame:
    """Overlap resolution, reading minimum, lead-out and cap.

    Only the first pass feeds forward, so only it is a fold; the later passes look one row
    back or ahead.  ``cues`` carries blocks over ``order`` (copies of the raw times and an
    id, so that they survive the passes), ``start_ms``, ``end_ms`` and ``text``.  ``media_end`` names a
    column with the end of the key's medium, the ceiling of its last cue; null or no column is no ceiling.
    ``placed`` is false for a cue left without length or begun before the end of the one before it.
    """
    keys, order = list(keys), list(order)
    cues = cues.withColumn("_media", F.lit(None).cast("bigint") if media_end is None else F.col(media_end).cast("bigint"))

    def resolve(state: State, row: tuple) -> tuple[State, list[tuple]]:
        start, end = int(row[0]), int(row[1])
        raw, pushed = start, state is not None and start < state[1] + GAP
        if pushed:
            before = max(state[0] + ROOM, start - GAP)
            start = max(start, before + GAP)
            end = max(end, start + ROOM)
        return [start, end], [(start, end, raw, int(pushed))]

    first = pin(
        fold(
            cues.withColumn("need", reading_need(F.col("text"))), keys, order, ["start_ms", "end_ms"], resolve,
            {"s1": "long", "e0": "long", "raw": "long", "pushed": "long"}, [*order, "need", "_media", ordered.BLOCK],
        ),
        "timing",
    )
    second = ordered.scan(
        first, keys, order, lead={"_raw": F.col("raw"), "_pushed": F.col("pushed"), "_s1": F.col("s1")}
    )
    e1 = F.when(F.col("_pushed") == 1, F.greatest(F.col("s1") + ROOM, F.col("_raw") - GAP)).otherwise(F.col("e0"))
    wanted = F.col("s1") + F.col("need")
    room = F.least(wanted, F.coalesce(F.col("_s1") - GAP, F.col("_media"), wanted))
    second = second.withColumn("e1", e1).withColumn("e2", F.greatest("e1", room))
    third = ordered.scan(second, keys, order, lag={"_e2": F.col("e2")})
    floor = F.coalesce(F.col("_e2") + GAP, F.lit(0))
    tight = F.col("e2") - F.col("s1") < F.col("need")
    s2 = F.when(tight, F.greatest(floor, F.least("s1", F.col("e2") - F.col("need")))).otherwise(F.col("s1"))
    third = pin(third.withColumn("s2", s2.cast("bigint")), "timing")
    last = ordered.scan(third, keys, order, lead={"_s2": F.col("s2")})
    lead_out = F.least(F.col("e2") + LEAD_OUT, F.coalesce(F.col("_s2") - GAP, F.col("_media"), F.col("e2") + LEAD_OUT))
    most = F.greatest(F.lit(MAX_CUE), "need")
    last = last.withColumn("e3", F.greatest("e2", lead_out))
    last = last.withColumn("capped", F.col("e3") - F.col("s2") > most)
    last = last.withColumn("end_ms", F.when(F.col("capped"), F.col("s2") + most).otherwise(F.col("e3")).cast("bigint"))
    shown = ordered.scan(last, keys, order, lag={"_shown": F.col("end_ms")})
    return shown.select(
        *keys, *order, F.col("s2").alias("start_ms"), "end_ms", "capped",
        (F.col("end_ms") - F.col("s2") < F.col("need")).alias("below_minimum"),
        ((F.col("end_ms") > F.col("s2")) & (F.col("_shown").isNull() | (F.col("s2") >= F.col("_shown")))).alias("placed"),
    )


def merge_flashes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], utterance: str) -> DataFrame:
    """Number display cues so that flashes under 0.4 s join a neighbour of the same utterance.

    A flash joins the cue before it, else it opens a cue that the next row continues.
    """
    tokens = ordered.scan(rows, keys, order, lead={"_next": F.col(utterance)})

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        start, end, mine, following = row
        start, end = int(start), int(end)
        last, waiting = [None, None] if state is None else state
        continues = waiting is not None and last == mine
        begin = waiting if continues else start
        if end - begin < FLASH:
            if last == mine and not continues:
                return [mine, None], [(0,)]
            if following == following and following is not None and following == mine:
                return [mine, begin], [(0 if continues else 1,)]
        return [mine, None], [(0 if continues else 1,)]

    marked = fold(
        tokens, keys, order, ["start_ms", "end_ms", utterance, "_next"], advance, {"opens": "long"},
        [*order, ordered.BLOCK],
    )
    return number_groups(marked, keys, order, "display_no")


def hold(cues: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Hold each cue for length / 10 s within [1, 6] s using only free time."""
    ready = ordered.scan(cues, keys, order, lead={"_next": F.col("start_ms")}).withColumns(
        {
            "_next": F.coalesce("_next", F.col("end_ms") + 1000),
            "_want": F.least(F.lit(6000), F.greatest(F.lit(1000), F.length("text") * 100)),
        }
    )

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        start, end, following, want = (int(v) for v in row)
        before = 0 if state is None else state[0]
        begin = max(before, start - 80)
        finish = min(following, max(end, begin + want))
        if finish - begin < FLASH:
            begin = max(before, min(begin, finish - 800))
        return [finish], [(begin, finish)]

    return fold(
        ready, keys, order, ["start_ms", "end_ms", "_next", "_want"], advance,
        {"hold_start": "long", "hold_end": "long"}, list(order),
    )


def repair(units: DataFrame, ids: Sequence[str], at: str, text: str, span: tuple[str, str]) -> DataFrame:
    """Re-time runs of implausibly fast units between their reliable neighbours.

    ``ids`` name one text, whose units are bounded by the text itself.  Texts with most
    characters implausible are flagged ``failed`` and keep their times.
    """
    lo, hi = span
    # One order of all units and one back suffice: a run's values are carried along from its first and last unit.
    line = Window.partitionBy(*ids).orderBy(at)
    first, here, last = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
    whole, upto = line.rowsBetween(first, last), line.rowsBetween(first, here)
    back = Window.partitionBy(*ids).orderBy(F.desc(at))  # units of one place see each other
    lex = tx.lexical_count(F.col(text))
    dur = F.col("end_ms") - F.col("start_ms")
    rows = units.withColumn("_lex", lex).withColumns(
        {"_bad": (F.col("_lex") > 0) & (dur < CHAR_FLOOR * F.col("_lex") - QUANTUM), "_w": F.greatest(F.lit(1), "_lex")}
    )
    bad_lex = F.sum(F.when(F.col("_bad"), F.col("_lex")).otherwise(0)).over(whole)
    rows = rows.withColumns(
        {
            "failed": bad_lex * 2 > F.greatest(F.lit(1), F.sum("_lex").over(whole)),
            "_run": F.sum(F.when(F.col("_bad") != F.coalesce(F.lag("_bad").over(line), ~F.col("_bad")), 1).otherwise(0)).over(line),
            "_prev_end": F.lag("end_ms").over(line), "_next_start": F.lead("start_ms").over(line),
            "_rows_w": F.sum("_w").over(upto), "_line_w": F.sum("_w").over(line),
        }
    )
    opens = ~F.col("_run").eqNullSafe(F.lag("_run").over(line))
    closes = ~F.col("_run").eqNullSafe(F.lead("_run").over(line))
    rows = rows.withColumns({"_opens": opens, "_closes": closes, "_low": F.max(F.struct("_run", -F.col("start_ms"))).over(upto)["col2"]})
    head = F.struct((F.col("_rows_w") - F.col("_w")).alias("w"), F.col(at).alias("at"))
    tail = F.struct(F.col("_rows_w").alias("w"), F.col("_next_start").alias("start"), (-F.col("_low")).alias("s"), F.col("end_ms").alias("e"))
    rows = rows.withColumn("_head", F.last(F.when(F.col("_opens"), head), True).over(upto))
    # Of several units at a run's first place, the last one's neighbour counts.
    before = F.when(F.col(at).eqNullSafe(F.col("_head.at")), F.struct(F.col("_prev_end").alias("end")))
    rows = rows.withColumn("_lead_in", F.last(before, True).over(line))
    rows = rows.withColumn("_tail", F.last(F.when(F.col("_closes"), tail), True).over(back))
    rows = rows.withColumns(
        {
            "_chars": F.col("_tail.w") - F.col("_head.w"), "_upto": F.col("_line_w") - F.col("_head.w"),
            "_before": F.col("_lead_in.end"), "_after": F.col("_tail.start"), "_s": F.col("_tail.s"), "_e": F.col("_tail.e"),
        }
    ).withColumn("_need", F.col("_chars") * REPAIR_PER_CHAR)
    left = F.coalesce(F.col("_before"), F.greatest(F.col(lo), F.coalesce(F.col("_after") - F.col("_need"), F.col(lo))))
    rows = rows.withColumn("_l", left)
    rows = rows.withColumn("_r", F.coalesce("_after", F.least(F.col(hi), F.col("_l") + F.col("_need"))))
    half = F.expr("_need div 2")
    centre = F.least(F.greatest(F.expr("(_s + _e) div 2"), F.col("_l") + half), F.col("_r") - half)
    wide = F.col("_r") - F.col("_l") > 2 * F.col("_need")
    rows = rows.withColumn("_c", centre).withColumns(
        {"_l2": F.when(wide, F.col("_c") - half).otherwise(F.col("_l")), "_r2": F.when(wide, F.col("_c") + half).otherwise(F.col("_r"))}
    )
    fix = F.col("_bad") & ~F.col("failed")
    return rows.select(
        *ids, at, "failed",
        F.when(fix, F.expr("_l2 + (_r2 - _l2) * (_upto - _w) div _chars")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(fix, F.expr("_l2 + (_r2 - _l2) * _upto div _chars")).otherwise(F.col("end_ms")).alias("end_ms"),
        fix.alias("repaired"),
    )
