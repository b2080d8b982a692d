"""Readings of texts by a readings table: the cheapest division into its words.

A text is a lattice: every word of the table that stands in it is an arc with the word's cost, every character
an arc of cost ``UNKNOWN`` that reads as itself.  The path of least cost wins; at equal cost the leftmost word
that is known, then the longer one.  A word may begin and end anywhere between kana and ideographs, but does
not cut a run of other letters or of numerals; unknown characters of one run make one word.

The table goes to the workers in blocks of bounded size.  With one block the path is taken where the arcs are
found.  Of several, each turns a text into an array of arcs, and the path is taken over the arcs of all blocks; a
text is one row throughout and is shuffled only for a table of several blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueloom.functions import text as tx
from cueloom.operators.dictionary import ATOM, lowered
from cueloom.shared import by_size, pin

#: Characters of surfaces and readings in one block.
BLOCK_CHARS = 4_000_000
#: Cost of a character that no word of the table covers.
UNKNOWN = 10_000
ARC = "struct<start:int,end:int,cost:bigint,reading:string>"
WORDS = "array<struct<surface:string,reading:string,known:boolean,start:int>>"
OPEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")


def _runs(text: str) -> tuple[list[int], set[int]]:
    """For every character the start of its run, and the places inside runs that no word may cut."""
    start_of, closed = [], set()
    for found in ATOM.finditer(text):
        start_of += [found.start()] * len(found[0])
        if not OPEN.match(found[0]):
            closed.update(range(found.start() + 1, found.end()))
    return start_of, closed


class Table:
    """Words of one block by their first character and length."""

    def __init__(self, surfaces: list[str], costs: list[int], readings: list[str]):
        self.word = dict(zip(surfaces, zip(costs, readings, strict=True), strict=True))
        lengths = defaultdict(set)
        for surface in surfaces:
            lengths[surface[0]].add(len(surface))
        self.lengths = {first: sorted(found) for first, found in lengths.items()}

    def arcs(self, text: str) -> list[tuple[int, int, int, str]]:
        low, found = lowered(text), []
        _, closed = _runs(low)
        for start, first in enumerate(low):
            if start in closed:
                continue
            for length in self.lengths.get(first, ()):
                end = start + length
                if end > len(low):
                    break
                word = self.word.get(low[start:end])
                if word is not None and end not in closed:
                    found.append((start, end, *word))
        return found


def cheapest(text: str, arcs: list[tuple[int, int, int, str]]) -> list[tuple[str, str, bool, int]]:
    """(surface, reading, known, start) along the cheapest path, filled in from the end of the text."""
    leaving = defaultdict(list)
    for arc in arcs:
        leaving[arc[0]].append(arc)
    total, step = [0] * (len(text) + 1), [None] * len(text)
    for at in range(len(text) - 1, -1, -1):
        best, step[at] = (total[at + 1] + UNKNOWN, 1, -1), None
        for arc in leaving.get(at, ()):
            rank = (total[arc[1]] + arc[2], 0, at - arc[1])
            if rank < best:
                best, step[at] = rank, arc
        total[at] = best[0]
    low, (run, _) = lowered(text), _runs(lowered(text))
    words, at = [], 0
    while at < len(text):
        arc, end = step[at], at + 1
        if arc is not None:
            end = arc[1]
        else:
            while end < len(text) and step[end] is None and run[end] == run[at]:
                end += 1
        words.append((text[at:end], low[at:end] if arc is None else arc[3], arc is not None, at))
        at = end
    return words


def _made(df: DataFrame, keep: Sequence[str], out: str, kind: str, make: Callable[[], Callable[..., list | None]], *given: str) -> DataFrame:
    """``keep`` and ``out`` (structs of type ``kind``), made row by row from the columns ``given``, a text first.

    Texts of some thousand characters are done at a time, as a text makes many times its size in Python objects.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, made = to_arrow_schema(schema), make()
        names = [f.name for f in target.field(out).type.value_type]
        for batch in (some for whole in batches for some in by_size(whole, len(keep))):
            rows = (made(*(v.as_py() for v in values)) for values in zip(*batch.columns[len(keep) :], strict=True))
            cells = pa.array([row if row is None else [dict(zip(names, r, strict=True)) for r in row] for row in rows], target.field(out).type)
            columns = [*batch.columns[: len(keep)], cells]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.select(*keep, *[F.col(c).alias(f"_given_{c}") for c in given]).mapInArrow(run, schema)


def _table_of(block: DataFrame) -> Callable[[], Table]:
    sent = block.sparkSession.sparkContext.broadcast(block.select("surface", "cost", "reading").toArrow())
    return lambda: Table(*(sent.value[c].to_pylist() for c in ("surface", "cost", "reading")))


def _with_arcs(df: DataFrame, text: str, block: DataFrame, keep: Sequence[str]) -> DataFrame:
    table = _table_of(block)

    def make():
        known = table()
        return lambda t: known.arcs(t or "")

    return _made(df, keep, "_arcs", f"array<{ARC}>", make, text)


def read_words(df: DataFrame, text: str, table: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``words``: the words of ``text`` with their readings, in order.

    ``table`` has ``surface`` (lower case), ``reading`` and ``cost`` (not negative); of several rows for a surface
    the cheapest counts, then the smallest reading.  A null text has null words, an empty one none; without a
    table every run is one unknown word.
    """
    one = table.filter("surface <> '' AND reading IS NOT NULL AND cost >= 0").groupBy("surface").agg(
        F.min(F.struct(F.col("cost").cast("bigint").alias("cost"), "reading")).alias("_r")
    )
    lexicon = pin(one.select("surface", "_r.cost", "_r.reading"), "readings")
    size = lexicon.agg(F.sum(F.char_length("surface") + F.char_length("reading") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    if blocks == 1:
        table_of = _table_of(lexicon)

        def whole():
            known = table_of()
            return lambda t: None if t is None else cheapest(t, known.arcs(t))

        return _made(df, keep, "words", WORDS, whole, text)
    wanted = list(dict.fromkeys([*keep, text]))
    numbered = pin(df.select(*wanted, F.monotonically_increasing_id().alias("_row")), "texts")
    parts = None
    for block in range(blocks):
        own = lexicon.filter(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == block)
        part = _with_arcs(numbered, text, own, ["_row"]).filter("size(_arcs) > 0")
        parts = part if parts is None else parts.unionByName(part)
    arcs = parts.groupBy("_row").agg(F.flatten(F.collect_list("_arcs")).alias("_arcs"))

    def path():
        return lambda t, a: None if t is None else cheapest(t, [tuple(arc.values()) for arc in a or []])

    return _made(numbered.join(arcs, "_row", "left"), keep, "words", WORDS, path, text, "_arcs")


def reading_of(words: Column | str) -> Column:
    """Reading normal form of a text from its words."""
    words = F.col(words) if isinstance(words, str) else words
    return tx.kana_reading(F.array_join(F.transform(words, lambda w: w["reading"]), ""))


def homophone_notes(lines: DataFrame, titles: DataFrame, text: str, work: str, keep: Sequence[str], shortest: int = 2) -> DataFrame:
    """``keep`` and ``notes``, sorted: title words whose reading a line of the work holds, though not the word itself.

    ``lines`` and ``titles`` have ``words`` from ``read_words``; of title words with one reading the first counts,
    readings under ``shortest`` characters do not.  A line's notes are bounded by the words of its own title.
    """
    spoken = lambda w: tx.kana_reading(w["reading"])
    heard = titles.select(work, F.explode(F.transform("words", lambda w: F.struct(
        spoken(w).alias("heard"), w["start"].alias("start"), w["surface"].alias("word")
    ))).alias("w")).filter(F.char_length("w.heard") >= shortest)
    first = heard.groupBy(work, F.col("w.heard").alias("_heard")).agg(F.min(F.struct("w.start", "w.word")).getField("word").alias("_word"))
    read = lines.select(*dict.fromkeys([*keep, work]), F.col(text).alias("_line"), reading_of("words").alias("_read"))
    hit = F.contains("_read", "_heard") & ~F.contains("_line", "_word")
    met = read.join(first, work).filter(hit)
    note = F.concat("_word", F.lit("("), "_heard", F.lit(")"))
    return met.groupBy(*keep).agg(F.array_sort(F.collect_list(note)).alias("notes"))


def spelling_conflict(left: Column, right: Column, left_words: Column, right_words: Column) -> Column:
    """Same reading, but other ideographs, both sides having some."""
    return reading_conflict(left, right, reading_of(left_words), reading_of(right_words))


def reading_conflict(left: Column, right: Column, left_reading: Column, right_reading: Column) -> Column:
    """``spelling_conflict`` of readings already taken."""
    a, b = tx.han_only(left), tx.han_only(right)
    return (left_reading == right_reading) & (a != "") & (b != "") & (a != b)
