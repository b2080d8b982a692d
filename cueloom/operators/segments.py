"""Ordered segmentation: scenes, utterances, display groups, greedy windows, pause cuts.

Gap rules are island queries.  Rules that feed forward (caps, greedy cuts) are folds over
blocks: ``advance(state, row)`` returns the next state and the rows it emits.  A state never
carries a counter, so a block started without its true entry state falls in step with the
true run after a few rows; numbers are given afterwards with a running sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cueloom.functions import text as tx
from cueloom.operators import ordered

State = ordered.State
SCENE_GAP_MS = 3000  # fixed value


def fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    advance: Callable[[State, tuple], tuple[State, list[tuple]]], outputs: dict[str, str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fold rows left to right inside each key; every row may emit any number of rows.

    ``keep`` columns of the emitting row are repeated on its output rows.
    """
    kept = [*keys, *keep]
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType(
        [fields[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in outputs.items()]
    )
    return ordered.fold_rows(df, keys, order, columns, advance, schema, kept)


def scenes_by_gap(cues: DataFrame, keys: Sequence[str], order: Sequence[str], gap_ms: int = SCENE_GAP_MS) -> DataFrame:
    return ordered.islands(
        cues, keys, order, ["start_ms", "end_ms"],
        lambda a, b: b["start_ms"] - a["end_ms"] >= gap_ms, out="scene",
    )


def scenes_with_caps(
    cues: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int, max_chars: int,
    gap_ms: int = SCENE_GAP_MS,
) -> DataFrame:
    """Scenes also end at a row cap or a character cap; adds ``scene`` (from 1)."""

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        start, end, size = (int(v) for v in row)
        opens = state is None
        if not opens:
            rows, chars, last = state
            opens = rows >= max_rows or chars + size > max_chars or start - last >= gap_ms
        rows, chars = (0, 0) if opens else (rows, chars)
        return [rows + 1, chars + size, end], [(int(opens),)]

    marked = fold(
        cues.withColumn("_size", F.length("text")), keys, order, ["start_ms", "end_ms", "_size"],
        advance, {"opens": "long"}, [*order, ordered.BLOCK],
    )
    return number_groups(marked, keys, order, "scene")


def number_groups(marked: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Running count of ``opens``."""
    numbered = ordered.scan(marked, keys, order, before={"_n": F.col("opens")})
    return numbered.withColumn(out, F.col("_n") + F.col("opens")).drop("_n", "opens", ordered.BLOCK)


# Suffixes a recogniser's full stop may not strand, and trailing particles.
UNFINISHED = r"(?:くらいなら|ことを|ことが|じゃ|では|来ん|意味|見たこと)[。！？!?]+$"
SENTENCE_CLOSE = r"[。！？!?][」』）)]?$"
TRAILING = (
    "って", "よ", "ね", "の", "か", "さ", "と", "が", "を", "に", "で",
)


def utterances(tokens: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """An utterance ends with its sentence unless the joined text ends in an unfinished suffix.

    A suffix is at most five characters before its terminators, and how many terminators follow
    does not matter; so the fold carries the last characters with a run of terminators as one.
    """

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        text, closes = row
        tail = "" if state is None or state[0] is None else state[0]
        opens = state is None or state[0] is None
        joined = _RUN.sub(r"\1", tail + text)[-8:]
        done = bool(closes) and not _UNFINISHED.search(joined)
        return [None if done else joined], [(int(opens),)]

    import re

    _UNFINISHED, _RUN = re.compile(UNFINISHED), re.compile(r"([。！？!?])[。！？!?]+$")
    marked = fold(
        tokens.withColumn("_closes", F.col("text").rlike(SENTENCE_CLOSE)), keys, order, ["text", "_closes"],
        advance, {"opens": "long"}, [*order, ordered.BLOCK],
    )
    return number_groups(marked, keys, order, "utterance")


def display_groups(
    tokens: DataFrame, keys: Sequence[str], order: Sequence[str],
    max_ms: int = 6000, max_chars: int = 38, pause_ms: int = 550,
) -> DataFrame:
    """Groups for display: break on a pause (not before a trailing particle), 6 s, 38 characters or a sentence end."""

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        start, end, size, particle, closes = row
        start, end, size = int(start), int(end), int(size)
        opens = state is None
        if not opens:
            first, last, chars, ended = state
            opens = (
                bool(ended) or (start - last >= pause_ms and not particle)
                or end - first > max_ms or chars + size > max_chars
            )
        if opens:
            first, chars = start, 0
        return [first, end, chars + size, int(closes)], [(int(opens),)]

    ready = tokens.withColumns(
        {
            "_size": F.length("text"),
            "_particle": tx.compact(F.col("text"), normalise=False).isin(*TRAILING),
            "_closes": F.col("text").rlike(SENTENCE_CLOSE),
        }
    )
    marked = fold(
        ready, keys, order, ["start_ms", "end_ms", "_size", "_particle", "_closes"],
        advance, {"opens": "long"}, [*order, ordered.BLOCK],
    )
    return number_groups(marked, keys, order, "group_no")


def greedy_windows(
    marks: DataFrame, keys: Sequence[str], at: str, kind: str, maximum: int, overlap: int, low: float = 0.65,
) -> DataFrame:
    """Windows of at most ``maximum``, cut at the last silence centre in the final 35 %.

    ``marks`` holds per recording its start (kind 0), silence centres (1) and end (2).  Where a
    stretch has no centre the cut falls at the maximum, so one mark may emit many windows.
    """
    floor = int(maximum * low)

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        here, what = int(row[0]), int(row[1])
        if state is None:
            return [here, None], []
        base, best = state
        made = []
        while here - base > maximum:
            cut = base + maximum if best is None else best
            made.append((base, cut))
            base, best = cut, None
        if what == 2:
            made.append((base, here))
        elif here - base >= floor:
            best = here
        return [base, best], made

    cut = ordered.range_blocks(marks, keys, [at, kind])
    cores = fold(cut, keys, [at, kind], [at, kind], advance, {"core_start": "long", "core_end": "long"})
    span = marks.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    return cores.join(span, list(keys)).select(
        *keys, "core_start", "core_end",
        F.greatest(F.col("core_start") - overlap, F.col("_lo")).alias("start_ms"),
        F.least(F.col("core_end") + overlap, F.col("_hi")).alias("end_ms"),
    )


def short_cores(owners: DataFrame, gaps: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Contiguous 2-8 s cores inside each owner, aiming at 6 s, cut at the nearest silence centre.

    The cuts of one owner are a fold in the JVM; a core is at least 2 s long, so an owner of n
    seconds has at most n / 2 of them, and that is the number of steps.
    """
    inside = gaps.select(key, at).distinct().groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("_gaps"))
    rows = owners.join(inside, key, "left").withColumn("_gaps", F.coalesce("_gaps", F.array().cast("array<bigint>")))

    def cut(cuts: Column) -> Column:
        here = F.element_at(cuts, -1)
        high = F.least(here + 8000, F.col(end) - 2000)
        near = F.filter(F.col("_gaps"), lambda x: (x >= here + 2000) & (x <= high))
        ranked = F.transform(near, lambda x: F.struct(F.abs(x - here - 6000).alias("d"), x.alias("x")))
        best = F.coalesce(F.array_min(ranked)["x"], F.least(here + 6000, high))
        return F.when(F.col(end) - here > 8000, F.concat(cuts, F.array(best))).otherwise(cuts)

    most = F.expr(f"greatest(1L, (`{end}` - `{start}`) div 2000)")
    steps = F.sequence(F.lit(1).cast("bigint"), most)
    cuts = F.aggregate(steps, F.array(F.col(start).cast("bigint")), lambda acc, _: cut(acc))
    ends = rows.withColumn("_cuts", F.concat(cuts, F.array(F.col(end).cast("bigint"))))
    spans = F.transform(
        F.slice("_cuts", 1, F.size("_cuts") - 1),
        lambda a, i: F.struct(a.alias("core_start"), F.element_at(F.col("_cuts"), i + 2).alias("core_end")),
    )
    cores = ends.select(key, start, end, F.posexplode(spans).alias("_i", "_c"))
    return cores.select(
        key, (F.col("_i") + 1).cast("bigint").alias("core_no"), "_c.core_start", "_c.core_end",
    )


def energy_cuts(
    frames: DataFrame, keys: Sequence[str], frame: str, power: str, total: str, unit: int,
) -> DataFrame:
    """Windows cut where the moving power is lowest in [18, 25] units, aiming at 22.

    A rest of at most 30 units is one window (halved when over 25); a rest of at most 40 is
    balanced into two.  ``frame`` counts from 0, ``total`` is the frame count of the key.
    """
    step = max(1, unit // 100)

    def plan(rest: int) -> tuple[int, int, int] | None:
        if rest <= 30 * unit:
            return None
        if rest <= 40 * unit:
            return max(15 * unit, rest - 25 * unit), min(25 * unit, rest - 15 * unit), rest // 2
        return 18 * unit, 25 * unit, 22 * unit

    def close(base: int, whole: int) -> list[tuple]:
        if whole - base > 25 * unit:
            half = (base + whole) // 2
            return [(base, half), (half, whole)]
        return [(base, whole)]

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        here, level, whole = (int(v) for v in row)
        base, best = [here, None] if state is None else state
        made = []
        window = plan(whole - base)
        if window is not None:
            low, high, aim = window
            off = here - base
            if low <= off <= high and ((off - low) % step == 0 or off in (high, aim)):
                rank = [level, abs(off - aim), here]
                best = rank if best is None else min(best, rank)
            if off == high:
                made.append((base, best[2]))
                base, best = best[2], None
        if here == whole - 1:
            made.extend(close(base, whole))
        return [base, best], made

    return fold(
        ordered.dense_blocks(frames, frame), keys, [frame], [frame, power, total], advance,
        {"start_frame": "long", "end_frame": "long"},
    )


def moving_power(samples: DataFrame, keys: Sequence[str], frame: str, value: str, half: int) -> DataFrame:
    """Mean square around each frame in thousandths, from rows within ``half`` frames."""
    from pyspark.sql import Window

    copies = ordered.with_halo(samples, frame, half, half)
    around = Window.partitionBy(*keys, ordered.BLOCK).orderBy(frame).rowsBetween(-half, half - 1)
    square = F.col(value) * F.col(value)
    out = copies.withColumn("power", F.floor(F.sum(square).over(around) * 1000 / F.count("*").over(around)))
    return out.filter("_core").drop("_core", ordered.BLOCK)


def pause_cuts(
    pieces: DataFrame, keys: Sequence[str], order: Sequence[str], *, minimum_gap: int = 2000, most: int | None = None,
) -> DataFrame:
    """Cut after a piece where the gap is long, mostly without speech, and both sides hold text.

    Needs ``lex``, ``rest_lex`` (lexical characters after the piece), ``gap_ms`` and
    ``speech_ms`` inside the gap.  ``most`` is an optional layout rule: cuts a key may have.
    Without it the state is the text held, and two characters are as good as more.
    """

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        lex, rest, gap, speech = (int(v) for v in row)
        held, count = [0, 0] if state is None else state
        held = min(2, held + lex)
        cut = gap >= minimum_gap and speech * 5 <= gap and min(held, rest) >= 2 and (most is None or count < most)
        counted = 0 if most is None else count + cut
        return ([0, counted], [(gap, speech)]) if cut else ([held, counted], [])

    return fold(
        pieces, keys, order, ["lex", "rest_lex", "gap_ms", "speech_ms"], advance,
        {"gap_ms": "long", "speech_ms": "long"}, list(order),
    )


def components(ids: DataFrame, keys: Sequence[str], number: str, radius: int) -> DataFrame:
    """Edits whose neighbourhoods touch form one component."""
    return ordered.islands(
        ids, keys, [number], [number], lambda a, b: b[number] - a[number] > 2 * radius, out="component"
    )
