"""Declared names in texts with or without spaces: longest occurrences, contexts, markers.

A text is read as *atoms*: runs of kana of one kind, single ideographs, runs of other letters, runs of
numerals, and whatever lies between, character by character.  A name stands where its characters do and
an atom begins and ends with it, so ``Ann`` is not in ``Anna`` nor ``ハル`` in ``ハルカ``, while a name between
ideographs or before a particle of the other kana is found.  Of names inside each other the longest stays.

The lexicon is cut into blocks of bounded size, each sent to the workers by itself; a block knows, for every
first atom, the lengths of the names that begin with it, and compares a text with them only where a hash of its next
characters is one of a name's beginning.  A text makes one row whatever it holds: its places are an
array, so nothing is shuffled to find them unless the lexicon has several blocks.  A worker holds the places of
some texts of a batch at a time.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from cueloom.shared import by_size, in_pieces, pin

#: Characters of names in one block.
BLOCK_CHARS = 4_000_000
ATOM = regex.compile(
    r"(?V1)[\p{Katakana}ー]+|\p{Hiragana}+|\p{Han}|[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+|\p{N}+|(?s:.)"
)
PLACE = "at int, words int, part int, start int, end int, left string, right string, alone boolean"


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: Kinds of characters; runs of a kind make one atom but for ideographs and what is no letter or numeral.
_OTHER, _KATAKANA, _HIRAGANA, _HAN, _LETTER, _NUMERAL, _HAN_NUMERAL = range(7)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point, and whether Python calls it a letter."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(len(every), np.uint8)
    for kind, own in (
        (_NUMERAL, r"\p{N}+"), (_LETTER, r"\p{L}+"), (_HAN, r"\p{Han}+"), (_HAN_NUMERAL, r"(?V1)[\p{Han}&&\p{N}]+"),
        (_HIRAGANA, r"\p{Hiragana}+"), (_KATAKANA, r"[\p{Katakana}ー]+"),
    ):
        for run in regex.finditer(own, every):
            kinds[run.start() : run.end()] = kind
    return kinds, np.fromiter(map(str.isalpha, every), bool, len(every))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _atom_starts(text: str, kinds: np.ndarray) -> np.ndarray:
    """Where the atoms of a text begin."""
    if (kinds == _HAN_NUMERAL).any():  # part of a run of numerals, else an ideograph
        return np.array([m.start() for m in ATOM.finditer(text)], np.int64)
    begins = np.ones(len(kinds), bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _HAN) | (kinds[1:] == _OTHER)
    return np.flatnonzero(begins)


def _beginnings(codes: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the 1, 2, 4 and 8 characters from each place on, for those of the ``sizes``, in increasing order."""
    hashed, size = codes.astype(np.uint64) * _MIX, 1
    for wanted in sorted(sizes):
        while size < wanted:
            hashed = hashed[:-size] * _MIX + hashed[size:] if len(hashed) > size else hashed[:0]
            hashed, size = (hashed ^ (hashed >> np.uint64(29))) * _MIX, 2 * size
        yield wanted, hashed


class Lexicon:
    """Names by first atom and length, and a table of the hashes of their beginnings: a text is compared with names only
    where such a hash stands."""

    def __init__(self, names: list[str]):
        self.number = {name: i for i, name in enumerate(names) if name}
        lengths, begin = defaultdict(set), defaultdict(set)
        for name in self.number:
            lengths[ATOM.match(name)[0]].add(len(name))
            size = min(8, 1 << len(name).bit_length() - 1)
            begin[size].add(name[:size])
        self.lengths = {atom: sorted(found, reverse=True) for atom, found in lengths.items()}
        self.shift = np.uint64(64 - max(12, (16 * len(self.number)).bit_length()))
        self.begin = {}
        for size, own in begin.items():
            (_, hashed), = _beginnings(_codes("".join(own)), [size])
            self.begin[size] = np.zeros(1 << 64 - int(self.shift), bool)
            self.begin[size][hashed[::size] >> self.shift] = True

    def _possible(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the atoms with which a name may begin; only a comparison tells."""
        hit = np.zeros(len(codes), bool)
        for size, hashed in _beginnings(codes, self.begin):
            hit[: len(hashed)] |= self.begin[size][hashed >> self.shift]
        return np.flatnonzero(hit[starts])

    def places(self, text: str | None) -> list[tuple]:
        """(at, words, part, start, end, left, right, alone, number) of the longest names, by their start.

        ``at`` counts the letter atoms up to the first of the name from 1 and ``words`` those in it; ``part`` counts
        letter atoms and the stretches between them from 0.  ``left`` and ``right`` are the letter atoms beside the
        name, ``alone`` is true if no other place of the text has them with as many letter atoms between.
        """
        low = lowered(text or "")
        codes = _codes(low)
        kinds, letter = _characters()
        starts = _atom_starts(low, kinds[codes])
        possible = self._possible(codes, starts)
        if not len(possible):
            return []
        letters = letter[codes[starts]]
        words, new = np.cumsum(letters), letters.copy()
        new[0] = True
        new[1:] |= letters[:-1]
        parts, stops = np.cumsum(new) - 1, np.append(starts[1:], len(low))
        edge = np.full(len(low) + 1, -1)
        edge[starts], edge[len(low)] = np.arange(len(starts)), len(starts)
        found, reach = [], 0
        rows = (column[possible].tolist() for column in (starts, stops, letters, words, parts))
        for start, stop, is_letter, word, part in zip(*rows, strict=True):
            for length in self.lengths.get(low[start:stop], ()):
                end = start + length
                if end <= reach:
                    break
                number = self.number.get(low[start:end]) if end < len(edge) else None
                if number is not None and edge[end] >= 0:
                    inside = int(words[edge[end] - 1]) - word + is_letter
                    found.append((word + (not is_letter), inside, part, start, end, number))
                    reach = end
                    break
        return _with_context(found, low, starts[letters], stops[letters])


def _with_context(found: list[tuple], low: str, starts: np.ndarray, stops: np.ndarray) -> list[tuple]:
    """``found`` with the letter atoms beside it; these begin and end at ``starts`` and ``stops``."""
    if not found:
        return []
    numbers = _codes(low)[starts].astype(np.int64)
    known: dict[str, int] = {}
    for i in np.flatnonzero(stops - starts > 1).tolist():
        numbers[i] = known.setdefault(low[starts[i] : stops[i]], 0x110000 + len(known))
    pairs: dict[int, np.ndarray] = {}
    out = []
    for at, words, part, start, end, number in found:
        if words not in pairs:
            pairs[words] = np.sort(numbers[: max(0, len(numbers) - words - 1)] << 32 | numbers[words + 1 :])
        left = low[starts[at - 2] : stops[at - 2]] if at > 1 else None
        right = low[starts[at + words - 1] : stops[at + words - 1]] if at + words <= len(starts) else None
        alone = False
        if left is not None and right is not None:
            pair = numbers[at - 2] << 32 | numbers[at + words - 1]
            low_at, high_at = np.searchsorted(pairs[words], [pair, pair + 1])
            alone = bool(high_at - low_at == 1)
        out.append((at, words, part, start, end, left, right, alone, number))
    return out


@functools.cache
def _outer():
    def outer(starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for own_starts, own_ends in zip(starts.to_pylist(), ends.to_pylist(), strict=True):
            kept, reach = [], 0
            for i in sorted(range(len(own_starts or ())), key=lambda i: (own_starts[i], -own_ends[i])):
                if own_ends[i] > reach:
                    kept.append(i)
                    reach = own_ends[i]
            out.append(kept)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(lambda *columns: in_pieces(outer, *columns), "array<int>")


def _outermost(places: str) -> Column:
    """Places of several blocks by their start, without those inside others."""
    return F.transform(_outer()(F.col(f"{places}.start"), F.col(f"{places}.end")), lambda i: F.get(places, i))


def place_names(df: DataFrame, text: str, names: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``places``: an array of the names in ``text`` with all columns of ``names``, by their start.

    ``names`` has one row per ``surface``, in lower case.  Without names, or in a null text, the array is empty.
    """
    size, n = names.agg(F.sum(F.char_length("surface") + 8), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_CHARS))
    if blocks == 1:
        return _placed(df, text, names, keep)
    # Rows are told apart by a number of their own, since ``keep`` need not be unique.
    numbered = pin(df.select(*keep, text, F.monotonically_increasing_id().alias("_row")), "texts")
    found = None
    for block in range(blocks):
        own = names.filter(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == block)
        one = _placed(numbered, text, own, ["_row"]).filter("size(places) > 0")
        found = one if found is None else found.unionByName(one)
    whole = found.groupBy("_row").agg(F.flatten(F.collect_list("places")).alias("all"))
    joined = numbered.drop(text).join(whole.select("_row", _outermost("all").alias("places")), "_row", "left").drop("_row")
    kind = found.schema["places"].dataType.simpleString()
    return joined.withColumn("places", F.coalesce("places", F.expr(f"CAST(array() AS {kind})")))


def _placed(df: DataFrame, text: str, names: DataFrame, keep: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    lexicon = names.toArrow()
    sent = spark.sparkContext.broadcast(lexicon)
    whole = T.StructType([*T._parse_datatype_string(PLACE).fields, *names.schema.fields])
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("places", T.ArrayType(whole, False), False)])
    fixed = [to_arrow_type(f.dataType) for f in whole.fields[: len(whole) - len(names.columns)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.combine_chunks()
        known = Lexicon(table["surface"].to_pylist())
        target = to_arrow_schema(schema)
        for batch in (some for whole in batches for some in by_size(whole, whole.num_columns - 1)):
            offsets, rows = [0], []
            for value in batch.column(batch.num_columns - 1):
                rows += known.places(value.as_py())
                offsets.append(len(rows))
            columns = list(zip(*rows, strict=True)) or [()] * (len(fixed) + 1)
            made = [pa.array(c, kind) for c, kind in zip(columns, fixed, strict=False)]
            own = table.take(pa.array(columns[-1], pa.int64()))
            made += [own[c].combine_chunks() if own.num_rows else pa.array([], own.schema.field(c).type) for c in own.column_names]
            places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(made, whole.names))
            columns = [*batch.columns[:-1], places]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def occurrences(df: DataFrame, ids: Sequence[str], text: str, surfaces: DataFrame) -> DataFrame:
    """One row per place of a name: ``ids``, the place, and the columns of ``surfaces``."""
    return place_names(df, text, surfaces, ids).select(*ids, F.inline("places"))


def _cut(text: str, starts: list[int], ends: list[int], parts: list[int]) -> tuple[str, list[str], list[str]]:
    """Text with markers, markers, and what they stand for; places that overlap another are left out."""
    out, markers, values, at = [], [], [], 0
    for i, (start, end, part) in enumerate(zip(starts, ends, parts, strict=True)):
        if (i and ends[i - 1] > start) or (i + 1 < len(starts) and starts[i + 1] < end):
            continue
        markers.append(f"⟦E{part:04d}⟧")
        values.append(text[start:end])
        out += [text[at:start], markers[-1]]
        at = end
    return "".join([*out, text[at:]]), markers, values


CUT = "marked string, markers array<string>, surfaces array<string>"
RESTORED = "restored string, exact boolean, markers bigint"
MARKER = regex.compile("⟦E[0-9]+⟧")


@functools.cache
def _put():
    def put(text: pa.Array, starts: pa.Array, ends: pa.Array, parts: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), parts.to_pylist(), strict=True)
        made = [(None, [], []) if t is None else _cut(t, *places) for t, *places in rows]
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["marked", "markers", "surfaces"])

    return F.arrow_udf(lambda *columns: in_pieces(put, *columns), CUT)


def marked(df: DataFrame, text: str, names: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``text``, and ``cut``: ``marked`` with numbered markers for names, the ``markers``, and the
    ``surfaces`` they stand for.  Names that overlap are in conflict and stay as they are."""
    found = place_names(df, text, names, [*keep, text])
    return found.select(*keep, text, _put()(F.col(text), F.col("places.start"), F.col("places.end"), F.col("places.part")).alias("cut"))


def _back(text: str, markers: list[str], surfaces: list[str]) -> tuple[str, bool, int]:
    known = dict(zip(markers, surfaces, strict=True))
    met = MARKER.findall(text)
    exact = sorted(met) == sorted(known) and len(known) == len(markers)
    return MARKER.sub(lambda m: known.get(m[0], m[0]), text), exact, len(known)


@functools.cache
def restored():
    """Column function of (marked text, markers, surfaces): ``restored``, ``exact`` if every marker stands in the text
    exactly once and no other does, and the number of ``markers``."""

    def back(text: pa.Array, markers: pa.Array, surfaces: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), markers.to_pylist(), surfaces.to_pylist(), strict=True)
        made = [(None, None, None) if t is None else _back(t, m or [], v or []) for t, m, v in rows]
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["restored", "exact", "markers"])

    return F.arrow_udf(lambda *columns: in_pieces(back, *columns), RESTORED)
