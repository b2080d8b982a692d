"""Benchmark decontamination by winnowing.

Words are hashed in runs of ``k``; of every ``window - k + 1`` consecutive runs the least hash is a
fingerprint (the rightmost of equal ones).  Two texts that share ``window`` consecutive words share
such a group of runs, hence a fingerprint at the same place in it.  Fingerprints of the benchmark
and of the documents are joined.  Every joint hit opens the words around it, as far as a window around the
fingerprint can reach, and hits close to each other open one stretch; in it all windows are compared with the item's
distinct windows, and words of equal ones are hit.  So a common span is followed to its ends, and the work is
linear in the words opened also where words repeat and every place equals every other.
An item with fewer words is one window of its own length: for those the fingerprints are all runs of
that length.  Windows are compared word by word, so the result is exact.

The benchmark is read in blocks of at most ``block_words`` words, each sent to the workers by
broadcast and matched in one pass over the documents; there is one pass unless the benchmark is
larger than that, and the result does not depend on the number of blocks.  Documents are not
shuffled; with more than one block their spans are joined by row key.

Defined cases: null and empty texts have no words and are never hit; items without words match
nothing; repeated item rows count once; items with a null id are matched under the name ``null``;
repeated documents each get a row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cueloom.llm.hashing import mix
from cueloom.shared import ship

#: Lower-case letters, digits and bytes from 0x80 stay, capitals are lowered, the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RUN, WINDOW, BLOCK_WORDS = 8, 13, 1_000_000
_CHUNK_WORDS = 100_000
_KEPT_ITEMS = 5_000
_SPANS = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
SPANS = "array<struct<item:string,first:bigint,last:bigint>>"


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of every ``width`` consecutive ones, the rightmost of equal ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, width):
        nearer = hashes[i : i + n] <= least
        least = np.where(nearer, hashes[i : i + n], least)
        at = np.where(nearer, np.arange(i, i + n), at)
    return np.unique(at)


class Index:
    """Fingerprints of one block of items: sorted hashes and their places, by (run length, width)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], k: int, window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.words = [self.number(words) for _, words in items]
        found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for n, ids in enumerate(self.words):
            shape = (k, window - k + 1) if len(ids) >= window else (len(ids), 1)
            hashes = _runs(ids, shape[0])
            at = winnow(hashes, shape[1])
            found.setdefault(shape, []).append((hashes[at], at, n))
        self.tables = {}
        for shape, parts in found.items():
            # An item's equal fingerprints count once: where they stand in it does not matter.
            pairs = np.unique(np.concatenate([np.stack([h, np.full(len(h), n, np.uint64)], 1) for h, _, n in parts]), axis=0)
            self.tables[shape] = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self._windows: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_windows": {}}

    def number(self, words: list[bytes]) -> np.ndarray:
        """Word numbers of this block, 0 for words that no item has."""
        return np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.uint64, len(words))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Hashes in order and words of the distinct windows of item ``n``, and how many may share a hash."""
        if n not in self._windows:
            own = self.words[n]
            length = min(self.window, len(own))
            rows = np.unique(np.lib.stride_tricks.sliding_window_view(own, length), axis=0)
            hashes = np.array([_runs(row, length)[0] for row in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            if len(self._windows) >= _KEPT_ITEMS:
                self._windows.clear()
            self._windows[n] = hashes[order], rows[order], int(np.unique(hashes, return_counts=True)[1].max())
        return self._windows[n]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Stretches covered by common windows (item number, first word, one past the last) in order of position."""
        hits: dict[int, list[int]] = {}
        for (run, width), (hashes, item) in self.tables.items():
            made = _runs(ids, run)
            at = winnow(made, width) if width > 1 else np.arange(len(made))
            low, high = np.searchsorted(hashes, made[at], "left"), np.searchsorted(hashes, made[at], "right")
            for k in np.flatnonzero(high > low).tolist():
                for n in item[low[k] : high[k]].tolist():
                    hits.setdefault(n, []).append(int(at[k]))
        found: list[tuple[int, int, int]] = []
        for n, places in hits.items():
            length = min(self.window, len(self.words[n]))
            for first, last in _merged(np.array(sorted(places)), -length, length):
                first, last = max(first, 0), min(last + length, len(ids))
                starts = first + self._equal(ids[first:last], n, length)
                found += [(n, a, b) for a, b in _merged(starts, 0, length)]
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    def _equal(self, ids: np.ndarray, n: int, length: int) -> np.ndarray:
        """Positions at which a window of item ``n`` begins."""
        hashes, rows, shared = self.windows(n)
        made = _runs(ids, length)
        low = np.searchsorted(hashes, made)
        here = np.lib.stride_tricks.sliding_window_view(ids, length) if len(made) else np.empty((0, length), ids.dtype)
        same = np.zeros(len(made), bool)
        for k in range(shared):
            at = np.minimum(low + k, len(hashes) - 1)
            maybe = np.flatnonzero(hashes[at] == made)
            same[maybe] |= (rows[at[maybe]] == here[maybe]).all(axis=1)
        return np.flatnonzero(same)


def _merged(starts: np.ndarray, before: int, after: int) -> list[tuple[int, int]]:
    """Stretches covered by ``start + before`` to ``start + after``; ``starts`` ascend."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > after - before)
    first = starts[np.append(0, cut + 1)] + before
    last = starts[np.append(cut, len(starts) - 1)] + after
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in order, cut so that no block has over ``block_words`` space-parted words (a longer item
    is a block of its own)."""
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")
    ).filter("text IS NOT NULL").distinct().orderBy("item", "text")
    held, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row.text) // 2 + 1
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((row.item, row.text))
        size += n
    if held:
        yield held


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", k: int = RUN, window: int = WINDOW,
    block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: struct ``own`` (doc_id and the ``carry`` columns), ``n_words`` and ``spans``
    (item, first, last): word positions ``first`` to ``last - 1`` of the document are covered by windows of the item."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry]).alias("own"),
        F.col(text_col).cast("string").alias("text"),
    )
    passes = []
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        parted = [(name, words) for name, text in block if (words := fold_words(text))]
        passes.append(_one_pass(kept, spark.sparkContext.broadcast(Index(parted, k, window))))
    if not passes:
        passes.append(_one_pass(kept, spark.sparkContext.broadcast(Index([], k, window))))
    if len(passes) == 1:
        return passes[0].select("own", "n_words", "spans")
    # Rows equal in everything carried and in text are told apart by their number among equals.
    rows = passes[0].withColumn("pass", F.lit(0))
    for n, more in enumerate(passes[1:], 1):
        rows = rows.unionByName(more.withColumn("pass", F.lit(n)))
    same = Window.partitionBy("own", "digest", "pass").orderBy("n_words")
    met = rows.withColumn("copy", F.row_number().over(same)).groupBy("own", "digest", "copy").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    return met.select("own", "n_words", "spans")


def _one_pass(kept: DataFrame, sent) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in batches:
            counts: list[int] = []
            spans: list[list[dict]] = []
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                words, ends = [], []
                while at < len(texts) and len(words) < _CHUNK_WORDS:
                    own = fold_words(texts[at])
                    words += own
                    words.append(b"")  # no item has it, so no span crosses documents
                    counts.append(len(own))
                    ends.append(len(words))
                    at += 1
                held: list[list[dict]] = [[] for _ in ends]
                for n, first, last in index.spans(index.number(words)):
                    d = bisect.bisect_right(ends, first)
                    base = ends[d - 1] if d else 0
                    held[d].append({"item": index.names[n], "first": first - base, "last": last - base})
                spans += held
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), batch.column("digest"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS)],
                names=["own", "digest", "n_words", "spans"],
            )

    own = kept.schema["own"].dataType.simpleString()
    keyed = kept.select("own", F.xxhash64("text").alias("digest"), "text")
    return keyed.mapInArrow(match, f"own {own}, digest bigint, n_words bigint, spans {SPANS}")
