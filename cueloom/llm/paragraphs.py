"""Substring deduplication: MinHash banding over paragraphs, exact verification, components.

A repeated passage stands anywhere, inside longer paragraphs too, where a paragraph as a whole no longer
resembles the other.  So the paragraphs compared here are cut by content: of every ``SPREAD``
consecutive word pairs the one of least hash is an anchor, and the ``WIDTH`` words from an anchor on
are a paragraph.  Of anchors within two words of each other the one of least hash counts, as their
paragraphs would resemble each other.  The same passage is cut in the same way wherever it stands;
any run of ``WIDTH + SPREAD + 2`` words, which is 48, holds a whole paragraph.

Beside these cuts stand the natural paragraphs, whole: blocks between blank lines of any length, and lines of
``WIDTH`` words or more (shorter lines inside a block are line deduplication's).  An edit anywhere in them leaves
them similar, where it would part every cut around it.  They have six bands of their own, so a pair at the
threshold meets with a probability of 99 %, and meet each other only.

A paragraph's set is its five-word shingles.  Bands of ``rows`` MinHashes put similar paragraphs together;
with two rows and four bands a pair at the threshold 3/4 meets with a probability of 96 %, one at
18 of 22 shingles, the first value below equality with one edge changed, with 99 %.
Paragraphs that meet are compared exactly, block by block, and linked when
their Jaccard similarity reaches 3/4; components of the links and of equal paragraphs are classes.  In each
class the earliest paragraph (by id, text hash, position) stays; the others are removed, together with the
words before and after them that equal those around the earliest one, or around the first equal one; what
touches or overlaps makes one span.

Of overlapping paragraphs of one text that share a band key one sends it and speaks for the others: if it
meets another paragraph, all of them are compared.
Texts are cut many at a time, and keys travel packed with the text that sends them (``shared_keys``); a text gets back
those that are sent twice, is cut again, and only its paragraphs with such a key become rows.  Any place of a paragraph
that stands in two is among them, as both send its keys or have them sent.  Names and bands are then compared whole,
and shingles are made for paragraphs of shared bands only.  No bucket is cut short; a block
of more than ``CHUNK`` paragraphs is linked chunk by chunk, and its groups are then joined exactly.

Defined cases: null texts and texts without words have no paragraph, keep all words and are their own class; repeated
rows (same id and text) are one document and get equal rows; null ids sort first and form a class of
their own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.components import components
from cueloom.llm.hashing import batch_word_hashes, mix, window_hashes, word_counts, word_hashes  # noqa: F401
from cueloom.llm.jaccard import all_links
from cueloom.llm.shared_keys import low_bits, shared_keys, sharing
from cueloom.shared import by_size, discard, pin, ship, tidy

WIDTH, SPREAD, SHINGLE, ROWS, BANDS, NATURAL_BANDS = 24, 22, 5, 2, 4, 6
MARGIN = WIDTH + SPREAD + 2  # so many equal words hold a whole cut
CUT_BYTES = 500_000  # of texts cut together
NEAR = 2  # words between anchors whose paragraphs would reach the threshold by themselves
SPANS = "array<struct<first:int,last:int>>"
_SEEDS = mix(np.arange(1, ROWS * NATURAL_BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Units(NamedTuple):
    """Paragraphs of texts: first word and number of words, name and band keys of each; keys of ``cuts`` (the content
    cuts) and of the natural ones are of different kinds.  Words and runs of all texts stand one after the other;
    ``at`` counts from the first of them, ``begins`` from the first word of the own text ``row``, whose runs end at
    ``stop``.  A text's cuts stand before its natural paragraphs."""

    at: np.ndarray
    n: np.ndarray
    names: np.ndarray
    keys: np.ndarray
    cuts: np.ndarray
    runs: np.ndarray
    row: np.ndarray
    begins: np.ndarray
    stop: np.ndarray

    def tokens(self, k: int) -> np.ndarray:
        """The sorted shingles of paragraph ``k``."""
        return np.unique(self.runs[self.at[k] : min(self.stop[k], self.at[k] + max(1, self.n[k] - SHINGLE + 1))])

    def packed(self, chosen: np.ndarray) -> list[bytes]:
        """The sorted shingles of paragraphs, as bytes; those of cuts are sorted together."""
        size = WIDTH - SHINGLE + 1
        own = np.sort(self.runs[self.at[chosen][self.cuts[chosen], None] + np.arange(size)], axis=1)
        once, flat, width, at, out = (own[:, 1:] != own[:, :-1]).all(axis=1).tolist(), own.tobytes(), own.itemsize * size, 0, []
        for k, cut in zip(chosen.tolist(), self.cuts[chosen].tolist(), strict=True):
            if cut and once[at]:
                out.append(flat[at * width : at * width + width])
            else:
                out.append(self.tokens(k).tobytes())
            at += cut
        return out


def natural(counts: list[int]) -> list[tuple[int, int]]:
    """(first word, number of words) of the blocks between blank lines, of lines of WIDTH words or more and of a
    text of fewer words, from the number of words of each line."""
    found, at, start = [], 0, 0
    for n in [*counts, 0]:
        if n >= WIDTH:
            found.append((at, n))
        if not n and at > start:
            found.append((start, at - start))
        at += n
        if not n:
            start = at
    if 0 < at < WIDTH:
        found.append((0, at))
    return sorted(set(found))


def content_cuts(hashed: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Start words of the content cuts of texts of ``sizes`` words, one after the other."""
    sizes = np.array([len(hashed)]) if sizes is None else sizes
    begin = np.cumsum(sizes) - sizes
    if not (sizes >= WIDTH).any():
        return np.empty(0, np.int64)
    pairs = window_hashes(hashed, 2)
    least, at, width = pairs, np.arange(len(pairs)), 1
    while width < SPREAD:
        # Rightmost least pair of twice as many, or of SPREAD.
        step = min(width, SPREAD - width)
        if len(least) <= step:
            least, at = least[:0], at[:0]
            break
        nearer = least[step:] <= least[:-step]
        at = np.where(nearer, at[step:], at[:-step])
        least, width = np.minimum(least[step:], least[:-step]), width + step
    whole = sizes >= WIDTH + SPREAD - 1
    first, counts = begin[whole], sizes[whole] - (WIDTH + SPREAD - 2)
    at = at[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    few = (sizes >= WIDTH) & ~whole
    if few.any():
        # From the last pair backwards, so the first of equal ones is the rightmost.
        last, back = (begin + sizes)[few, None] - WIDTH, np.arange(SPREAD)
        inside = back < (sizes[few, None] - WIDTH + 1)
        chosen = np.where(inside, pairs[np.maximum(last - back, 0)], ~np.uint64(0)).argmin(axis=1)
        at = np.sort(np.concatenate([at, last[:, 0] - chosen]))
    alone = np.ones(len(at), bool)
    for step in range(1, NEAR + 1):
        close = at[step:] - at[:-step] <= NEAR
        left, right = pairs[at[:-step]], pairs[at[step:]]
        alone[step:] &= ~(close & (left < right))
        alone[:-step] &= ~(close & (right <= left))
    return at[alone]


def _text_runs(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each word on, as far as they stand in its text; of all words of a shorter text."""
    runs = np.zeros(len(hashed), np.uint64)
    whole = window_hashes(hashed, SHINGLE)
    runs[: len(whole)] = whole
    begin = np.cumsum(sizes) - sizes
    for k in range(1, SHINGLE):
        at = begin[sizes == k]
        if len(at):
            runs[at] = window_hashes(hashed[at[:, None] + np.arange(k)].T, k)[0]
    return runs


def units(texts: list[str | None], keyed: bool = True) -> Units:
    """The paragraphs of texts, cut together; if not ``keyed``, band keys are 0."""
    hashed, lines = batch_word_hashes(texts)
    sizes, own, counts, before = [], [], [], 0
    for line in lines:
        made = natural(line)
        own += [(before + a, m) for a, m in made]
        counts.append(len(made))
        sizes.append(sum(line))
        before += sizes[-1]
    sizes = np.array(sizes, np.int64)
    begin = np.cumsum(sizes) - sizes
    runs = _text_runs(hashed, sizes)
    cut = content_cuts(hashed, sizes)
    first, n = np.array(own, np.int64).reshape(-1, 2).T
    row = np.repeat(np.arange(len(texts)), counts)
    stop = begin + np.maximum(sizes - SHINGLE + 1, 1)
    ends_at = stop[row]
    ends = np.minimum(first + np.maximum(n - SHINGLE + 1, 1), ends_at)
    edges = np.stack([np.minimum(first, ends_at - 1), ends], axis=1).ravel()
    short, long = [], []
    for k, seed in enumerate(_SEEDS if keyed and own else ()):
        mixed = mix(runs ^ seed)
        if k < ROWS * BANDS and len(cut):
            short.append(_least(mixed, cut, WIDTH - SHINGLE + 1))
        long.append(np.minimum.reduceat(np.append(mixed, ~np.uint64(0)), edges)[::2])
    keys = np.zeros((len(cut) + len(own), NATURAL_BANDS), np.uint64)
    if short:
        keys[: len(cut), :BANDS] = bands(short, 0)
    if long:
        keys[len(cut) :] = bands(long, BANDS)
    parts = [xxhash.xxh64_intdigest(hashed[a : a + m], 1) for a, m in own]
    row = np.concatenate([np.searchsorted(begin + sizes, cut, "right"), row])
    order = np.argsort(row, kind="stable")
    at, row = np.concatenate([cut, first])[order], row[order]
    return Units(
        at, np.concatenate([np.full(len(cut), WIDTH), n])[order],
        np.concatenate([names(runs, cut), np.array(parts, np.uint64).view(np.int64)])[order], keys[order],
        order < len(cut), runs, row, at - begin[row], stop[row],
    )


def paragraphs(text: str | None) -> Units | None:
    own = units([text])
    return own if len(own.at) else None


def _least(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each of ``at`` on."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[reach:], values[:-reach])
        reach *= 2
    return np.minimum(values[at], values[at + width - reach])


def names(runs: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit name of each cut's words."""
    out = np.zeros(len(cut), np.uint64)
    for k in range(WIDTH - SHINGLE + 1):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + runs[cut + k])
    return out.view(np.int64)


def bands(least: list[np.ndarray], kind: int) -> np.ndarray:
    """Keys of paragraphs from their least hashes; bands are numbered from ``kind`` on."""
    keys = []
    for b in range(len(least) // ROWS):
        key = np.full(len(least[0]), kind + b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        keys.append(key)
    return np.stack(keys, axis=1)


def _spoken(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which band keys of paragraphs (flat) are sent, and (paragraph, speaker) for those that are not: an overlapping
    paragraph before it sends the same key.  Overlapping paragraphs of one text are no repetition."""
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    edge = np.flatnonzero(np.append(True, ~same)) if len(flat) else np.empty(0, np.int64)
    length = np.diff(np.append(edge, len(flat)))
    longest = np.argsort(-length, kind="stable")
    longest = longest[: np.count_nonzero(length > 1)]
    edge, length = edge[longest], length[longest]
    speaker = order[edge] // keys.shape[1]
    sent, held = np.ones(len(flat), bool), [np.empty((0, 2), np.int64)]
    for k in range(1, int(length[0]) if len(length) else 0):
        # The next holder of every key that has so many.
        m = np.searchsorted(-length, -k)
        key = order[edge[:m] + k]
        own = key // keys.shape[1]
        near = at[own] - at[speaker[:m]] < WIDTH
        sent[key[near]] = False
        held.append(np.stack([own[near], speaker[:m][near]], axis=1))
        speaker[:m] = np.where(near, speaker[:m], own)
    held = np.concatenate(held)
    pairs = np.unique(held[:, 0] * max(1, len(at)) + held[:, 1])
    return sent, np.stack(np.divmod(pairs, max(1, len(at))), axis=1)


def _name_keys(names: np.ndarray) -> np.ndarray:
    """The only key of natural paragraphs under SHINGLE words, which have no near partner."""
    return mix(names.view(np.uint64))


def _sent_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts (doc, text) of a batch, part by part, place of the text and key of all keys that their paragraphs send."""
    for part in by_size(batch, 1, CUT_BYTES):
        own = units(part.column("text").to_pylist())
        keys = own.keys[own.cuts, :BANDS]
        sent, _ = _spoken(own.at[own.cuts], keys)
        long, short = ~own.cuts & (own.n >= SHINGLE), ~own.cuts & (own.n < SHINGLE)
        yield (
            part.column("doc").to_numpy(),
            np.concatenate([np.repeat(own.row[own.cuts], BANDS)[sent], np.repeat(own.row[long], NATURAL_BANDS), own.row[short]]),
            np.concatenate([keys.ravel()[sent], own.keys[long].ravel(), _name_keys(own.names[short])]),
        )


def _named_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The names of a batch (doc, keys, sent), place of the name and key of the keys that are sent."""
    keys, sent = batch.column("keys"), batch.column("sent").to_numpy()
    counts = pc.list_value_length(keys).to_numpy()
    keys, row = keys.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(keys)) - (np.cumsum(counts) - counts)[row] < sent[row]
    yield batch.column("doc").to_numpy(), row[first], keys[first]


def _digest(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _occurrences(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, digest, at, n, name, via, keys, sent): every paragraph of ``docs`` (doc, doc_id, text) with one of the
    keys of ``met`` (doc, keys).  ``via`` names the paragraphs that send keys of its own; of its ``keys`` it sends
    the first ``sent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, CUT_BYTES):
                texts, asked = part.column("text").to_pylist(), part.column("met").to_pylist()
                own = units(texts)
                cuts, short = np.flatnonzero(own.cuts), ~own.cuts & (own.n < SHINGLE)
                asked = [np.frombuffer(k, "<u4") for k in asked]
                place = np.repeat(np.arange(len(asked)), [len(k) for k in asked])
                wanted = np.concatenate(asked) + (place.astype(np.uint64) << np.uint64(32))
                keys = own.keys.copy()
                keys[short] = _name_keys(own.names[short])[:, None]
                there = np.isin(low_bits(keys) + (own.row.astype(np.uint64) << np.uint64(32))[:, None], wanted)
                there[own.cuts, BANDS:] = False
                chosen = np.flatnonzero(there.any(axis=1))
                sent = np.ones(keys.shape, bool)
                flat, held = _spoken(own.at[cuts], own.keys[cuts, :BANDS])
                sent[cuts, :BANDS], sent[cuts, BANDS:] = flat.reshape(-1, BANDS), False
                counts = np.where(own.cuts, BANDS, np.where(short, 0, NATURAL_BANDS))[chosen]
                order = np.argsort(~sent[chosen], axis=1, kind="stable")
                # The bands a cut does not have come last, as bands are in order among those not sent.
                blocks = np.take_along_axis(keys[chosen], order, axis=1)[np.arange(NATURAL_BANDS) < counts[:, None]]
                place, speaker = cuts[held].T
                low, high = np.searchsorted(place, chosen), np.searchsorted(place, chosen, "right")
                via = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
                edges = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(own.row[chosen], pa.int64())),
                    pa.array(np.array([_digest(t) for t in texts], np.int64)[own.row[chosen]], pa.int64()),
                    pa.array(own.begins[chosen], pa.int32()), pa.array(own.n[chosen], pa.int32()),
                    pa.array(own.names[chosen], pa.int64()),
                    pa.ListArray.from_arrays(edges(high - low), pa.array(own.names[speaker[via]], pa.int64())),
                    pa.ListArray.from_arrays(edges(counts), pa.array(blocks.view(np.int64), pa.int64())),
                    pa.array(np.minimum(sent[chosen].sum(axis=1), counts), pa.int32()),
                ], ["doc_id", "digest", "at", "n", "name", "via", "keys", "sent"])

    texts = docs.join(met.withColumnRenamed("keys", "met").hint("merge"), "doc").select("doc_id", "text", "met")
    return texts.mapInArrow(
        run, "doc_id bigint, digest bigint, at int, n int, name bigint, via array<bigint>, keys array<bigint>, sent int"
    )


def _bands(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, digest, at, end, blocks): the wanted paragraphs (doc_id, digest, names) with their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0, CUT_BYTES):
                texts, digests, wish = (part.column(c).to_pylist() for c in ("text", "digest", "names"))
                right = np.array([_digest(t) == d for t, d in zip(texts, digests, strict=True)])
                own = units(texts)
                edges = np.searchsorted(own.row, np.arange(len(texts) + 1))
                chosen = np.concatenate([
                    np.flatnonzero(np.isin(own.names[low:high], w)) + low
                    for low, high, w in zip(edges[:-1], edges[1:], wish, strict=True)
                ])
                chosen = chosen[right[own.row[chosen]]]
                counts = np.where(own.cuts[chosen], BANDS, NATURAL_BANDS)
                blocks = own.keys[chosen][np.arange(NATURAL_BANDS) < counts[:, None]].view(np.int64)
                edges = np.append(0, np.cumsum(counts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.names[chosen], pa.int64()),
                    pa.array(np.array(digests, np.int64)[own.row[chosen]], pa.int64()),
                    pa.array(own.begins[chosen], pa.int32()), pa.array((own.begins + own.n)[chosen], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(blocks, pa.int64())),
                ], ["sid", "digest", "at", "end", "blocks"])

    met = docs.join(wanted.hint("merge"), "doc_id").select("text", "digest", "names")
    return met.mapInArrow(run, "sid bigint, digest bigint, at int, end int, blocks array<bigint>")


def _tokens(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(sid, own, tokens): shingles of the paragraphs needed (doc_id, digest, named: array of (sid, own))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            for part in by_size(batch, 0, CUT_BYTES):
                texts, ids, digests = (part.column(c).to_pylist() for c in ("text", "doc_id", "digest"))
                right = []
                for text, doc_id, digest in zip(texts, ids, digests, strict=True):
                    # Rows of a repeated document stand together.
                    last, seen = doc_id, seen if last == doc_id else set()
                    right.append(digest not in seen and _digest(text) == digest)
                    if right[-1]:
                        seen.add(digest)
                part = part.filter(pa.array(right, pa.bool_()))
                own = units([t for t, fits in zip(texts, right, strict=True) if fits], keyed=False)
                named = part.column("named")
                counts = pc.list_value_length(named).to_numpy()
                named = named.flatten()
                wish, ends = pc.struct_field(named, "sid").to_numpy(), np.cumsum(counts)
                edges, chosen = np.searchsorted(own.row, np.arange(len(counts) + 1)), [np.empty(0, np.int64)]
                for low, high, a, b in zip(edges[:-1], edges[1:], ends - counts, ends, strict=True):
                    order = np.argsort(own.names[low:high], kind="stable")
                    chosen.append(order[np.searchsorted(own.names[low:high], wish[a:b], sorter=order)] + low)
                tokens = own.packed(np.concatenate(chosen))
                yield pa.RecordBatch.from_arrays(
                    [pc.struct_field(named, "sid"), pc.struct_field(named, "own"), pa.array(tokens, pa.binary())], ["sid", "own", "tokens"]
                )

    met = docs.join(needed.hint("merge"), "doc_id").select("text", "doc_id", "digest", "named")
    return met.mapInArrow(run, "sid bigint, own array<bigint>, tokens binary")


def _blocks(docs: DataFrame, wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sid, block, tokens): the wanted paragraphs (doc_id, digest, names) with each band they share; ``known`` has
    their places and bands (sid, digest, at, end, blocks), if these were made before.

    Shingles are made for paragraphs that share a band alone.  A band whose paragraphs all overlap in one text is
    none: equal ones elsewhere are found by their names."""
    made = _bands(docs, wanted) if known is None else known
    light = pin(made.select("sid", "digest", "at", "end", F.explode("blocks").alias("block")), "candidates")
    mixed = F.xxhash64("sid")
    shared = light.groupBy("block").agg(
        F.min("sid").alias("a"), F.max("sid").alias("b"), F.min("digest").alias("c"), F.max("digest").alias("d"),
        F.max("at").alias("at"), F.min("end").alias("end"),
        F.count("*").alias("n"), F.sum(mixed.bitwiseAND(0x7FFFFFFF)).alias("low"),
        F.sum(F.shiftrightunsigned(mixed, 31)).alias("high"),
    ).filter("a <> b AND (c <> d OR at >= end)")
    # Near copies share most of their bands: of blocks with the same members one is compared.
    shared = shared.groupBy("a", "b", "n", "low", "high").agg(F.min("block").alias("block")).select("block")
    bands = pin(light.join(shared, "block", "left_semi").groupBy("sid").agg(F.collect_set("block").alias("own")), "shared")
    discard(light)
    named = wanted.select("doc_id", "digest", F.explode("names").alias("sid"))
    needed = named.join(bands, "sid").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("sid", "own")).alias("named"))
    tokens = pin(_tokens(docs, needed), "blocks")
    discard(bands)
    return tokens.select("sid", F.explode("own").alias("block"), "tokens")


def _stretches(repeats: DataFrame) -> DataFrame:
    """(doc_id, digest, first, last, to_id, to, to_first, to_last): stretches of a text's repeated paragraphs that
    touch or overlap and stand in the same way to words of an earlier place."""

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] * 2
    names = ["doc_id", "digest", "first", "last", "to_id", "to", "to_first", "to_last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy()
            places = places.flatten()
            at, n = (pc.struct_field(places, c).to_numpy() for c in ("at", "n"))
            fields, row = [], np.repeat(np.arange(batch.num_rows), counts)
            for name in ("lead", "near"):
                there = pc.is_valid(pc.struct_field(places, name)).to_numpy(zero_copy_only=False)
                to = places.filter(pa.array(there))
                own, digest, begin, size = (pc.struct_field(to, [name, c]) for c in ("doc_id", "digest", "at", "n"))
                fields.append((
                    row[there], pc.is_null(own).to_numpy(zero_copy_only=False), pc.fill_null(own, 0).to_numpy(),
                    digest.to_numpy(), at[there], n[there], begin.to_numpy(), size.to_numpy(),
                ))
            row, unnamed, own, digest, at, n, begin, size = map(np.concatenate, zip(*fields, strict=True))
            where = row, unnamed, own, digest, at - begin
            order = np.lexsort((size, n, at, *where[::-1]))
            row, unnamed, own, digest, shift = where = [c[order] for c in where]
            at, begin, last, to_last = at[order], begin[order], (at + n)[order], (begin + size)[order]
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in where])) if len(row) else np.empty(0, bool)
            # How far the places before reach, of those that stand in the same way.
            group = np.cumsum(new).astype(np.int64) << 32
            reached = np.maximum.accumulate(group + last)
            new[1:] |= (group + at)[1:] > reached[:-1]
            edge = np.flatnonzero(new)
            if len(edge):
                most = np.maximum.reduceat(last, edge)
                full = last == np.repeat(most, np.diff(np.append(edge, len(last))))
                to_last = to_last[np.minimum.reduceat(np.where(full, np.arange(len(last)), len(last)), edge)]
                last = most
            columns = [
                batch.column("doc_id").take(pa.array(row[edge])), batch.column("digest").take(pa.array(row[edge])), at[edge],
                last, pa.array(own[edge], pa.int64(), mask=unnamed[edge]), digest[edge], begin[edge], to_last,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return repeats.mapInArrow(run, "doc_id bigint, digest bigint, first int, last int, to_id bigint, to bigint, to_first int, to_last int")


def _with_words(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """(text, words, *columns) of the rows of stretches of CUT_BYTES; words as 32-bit hashes."""
    for batch in batches:
        for part in by_size(batch, batch.schema.get_field_index("text"), CUT_BYTES):
            texts = part.column("text").to_pylist()
            hashed, lines = batch_word_hashes(texts)
            words = np.split(hashed.astype(np.uint32), np.cumsum([sum(own) for own in lines])[:-1])
            yield list(zip(texts, words, *(part.column(c).to_pylist() for c in columns), strict=True))


def common(mine: np.ndarray, other: np.ndarray) -> int:
    """How many words are equal from the start on."""
    n = min(len(mine), len(other))
    differ = np.flatnonzero(mine[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


def reach(mine: np.ndarray, other: np.ndarray, shifts: bool) -> int:
    """How far words go on as those at the earlier place, which begin NEAR words before its end: an edit at the
    edge of a cut may have moved them by as many."""
    found = common(mine, other[NEAR:])
    if not found and shifts:
        far = max(common(mine, other[k:]) for k in range(2 * NEAR + 1))
        found = far if far >= SHINGLE else 0
    return found


def _spans(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): stretches extended word by word along their earlier places, then merged.

    Of an earlier place MARGIN words on each side are read: further equal words hold a whole cut, which is a
    stretch itself.  Each word removed stands for an equal or similar one at an earlier place, so one stays."""
    place = ["to_first", "to_last"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _with_words(batches, "doc_id", "digest", "asked"):
            out = []
            for text, own, doc_id, digest, asked in rows:
                if _digest(text) != digest:
                    continue
                for a in asked:
                    low, high = a["to_first"], a["to_last"]
                    left, right = own[max(0, low - MARGIN) : low + NEAR][::-1], own[max(0, high - NEAR) : high + MARGIN]
                    out.append((doc_id, digest, low, high, left.tobytes(), np.ascontiguousarray(right).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["at_id", "at", *place, "left", "right"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _with_words(batches, "doc_id", "digest", "held"):
            ids, digests, out = [], [], []
            for text, own, doc_id, digest, held in rows:
                if _digest(text) != digest:
                    continue
                found = []
                for s in held:
                    left, right = (np.frombuffer(s[c], np.uint32) for c in ("left", "right"))
                    before = reach(own[max(0, s["first"] - MARGIN) : s["first"]][::-1], left, s["other"])
                    after = reach(own[s["last"] : s["last"] + MARGIN], right, s["other"])
                    found.append((s["first"] - before, s["last"] + after))
                merged = []
                for first, last in sorted(found):
                    if merged and merged[-1]["last"] >= first:
                        merged[-1]["last"] = max(merged[-1]["last"], last)
                    else:
                        merged.append({"first": first, "last": last})
                ids.append(doc_id)
                digests.append(digest)
                out.append(merged)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(out, kind)], ["doc_id", "digest", "spans"]
            )

    def with_text(keys: DataFrame) -> DataFrame:
        texts = docs.withColumnRenamed("doc_id", "own_id")
        return keys.join(texts, keys["doc_id"].eqNullSafe(texts["own_id"])).drop("own_id")

    asked = stretches.groupBy(F.col("to_id").alias("doc_id"), F.col("to").alias("digest")).agg(
        F.collect_set(F.struct(*place)).alias("asked")
    )
    edge = with_text(asked).mapInArrow(
        edges, "at_id bigint, at bigint, to_first int, to_last int, left binary, right binary"
    ).dropDuplicates(["at_id", "at", *place])
    same = stretches["to_id"].eqNullSafe(edge["at_id"]) & (stretches["to"] == edge["at"])
    for c in place:
        same &= stretches[c] == edge[c]
    other = ~(F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("digest") == F.col("to")))
    held = stretches.join(edge, same).groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("first", "last", "left", "right", other.alias("other"))).alias("held")
    )
    found = with_text(held).mapInArrow(run, f"doc_id bigint, digest bigint, spans {SPANS}")
    return found.dropDuplicates(["doc_id", "digest"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest (of the text), n_words, class_id (least id of the documents its
    passages connect it with), first_ids (ids where its repeated passages stand first) and spans of
    words to remove."""
    ship(docs.sparkSession)
    with tidy(docs.sparkSession):
        return _passages(docs, id_col, text_col)


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = own.withColumn("doc", F.xxhash64("doc_id", "text"))
    asked = pin(shared_keys(texts.select("doc", "text"), _sent_keys, buckets), "met")
    # A place is left out if no other one, not overlapping, sends any of its keys.
    every = pin(_occurrences(texts, asked), "occurrences")
    discard(asked)
    met = sharing(every.select(F.col("name").alias("doc"), "keys", "sent"), _named_keys, buckets)
    met = met.select(F.col("doc").alias("name"))
    stands = F.struct("doc_id", "digest", "at", "n")
    named = every.groupBy("name").agg(F.min(stands).alias("first"), F.max(stands).alias("last"))
    # A paragraph matters if it stands in two places or shares a band with another one.
    sure = pin(
        named.join(met.withColumn("near", F.lit(True)), "name", "left")
        .filter((F.col("first") != F.col("last")) | F.col("near").isNotNull()).select("name", "first", "near"), "sure"
    )
    # Or if the paragraph that sends its keys does.
    sender = every.select("name", stands.alias("stand"), F.explode("via").alias("via")).groupBy("name", "via").agg(F.min("stand").alias("stand"))
    through = sender.join(sure.select(F.col("name").alias("via")), "via").groupBy("name").agg(F.min("stand").alias("stand"))
    kept = pin(
        sure.join(through, "name", "full").select(
            "name", F.coalesce("first", "stand").alias("first"),
            (F.col("near").isNotNull() | F.col("stand").isNotNull()).alias("near"),
        ), "paragraphs"
    )
    discard(sure)
    near = kept.filter("near AND first.doc_id IS NOT NULL").select("name", "first.doc_id", "first.digest")
    wanted = near.groupBy("doc_id", "digest").agg(F.collect_list("name").alias("names"))
    known = every.join(near, ["name", "doc_id", "digest"], "left_semi").select(
        F.col("name").alias("sid"), "digest", "at", (F.col("at") + F.col("n")).alias("end"), F.col("keys").alias("blocks")
    )
    blocks = _blocks(own, wanted, known)
    links = all_links(blocks, 3, 4)
    linked = components(links)
    discard(blocks, links)
    rooted = kept.join(linked.select(F.col("node").alias("name"), "root"), "name", "left").select(
        "name", "first", F.coalesce("root", "name").alias("root")
    )
    leads = rooted.groupBy("root").agg(F.min("first").alias("lead"))
    classes = rooted.join(leads, "root").select("name", "lead", "first")
    again = lambda c: (stands != F.col(c)) & ~(
        F.col("doc_id").eqNullSafe(F.col(f"{c}.doc_id")) & (F.col("digest") == F.col(f"{c}.digest"))
        & (F.col("at") < F.col(f"{c}.at") + F.col(f"{c}.n"))
    )
    repeats = pin(
        every.join(classes, "name").filter(again("lead"))
        .withColumn("near", F.when((F.col("first") != F.col("lead")) & (F.col("first") < stands) & again("first"), F.col("first")))
        .groupBy("doc_id", "digest").agg(
            F.collect_set(F.struct("at", "n", "lead", "near")).alias("places"),
            F.array_sort(F.collect_set("lead.doc_id")).alias("first_ids"),
        ), "repeats"
    )
    discard(every, kept, linked)
    spans = _spans(own, pin(_stretches(repeats), "stretches"))
    joined = components(repeats.select(F.col("doc_id").alias("a"), F.explode("first_ids").alias("b")))
    sizes = _sizes(own)
    ids, spans = repeats.select("doc_id", "digest", "first_ids"), spans.withColumnsRenamed({"doc_id": "own_id", "digest": "own"})
    found = ids.join(spans, ids["doc_id"].eqNullSafe(spans["own_id"]) & (ids["digest"] == spans["own"]))
    found = found.select("doc_id", "digest", "first_ids", "spans")
    same = sizes["doc_id"].eqNullSafe(found["doc_id"]) & (sizes["digest"] == found["digest"])
    out = sizes.join(found, same, "left").select(sizes["doc_id"], sizes["digest"], "n_words", "first_ids", "spans")
    return out.join(joined.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(
        "doc_id", "digest", "n_words", F.coalesce("root", "doc_id").alias("class_id"),
        F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
    )


def _sizes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, CUT_BYTES):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([_digest(t) for t in texts], pa.int64()), pa.array(word_counts(texts), pa.int64()),
                ], ["doc_id", "digest", "n_words"])

    return docs.mapInArrow(run, "doc_id bigint, digest bigint, n_words bigint")


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the documents without the words of ``found``'s spans; white space between words kept
    stays as it was, a removed span takes the white space after it along."""
    import re

    word = re.compile(r"[^\x20\x09-\x0d]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "digest", "spans")]
            for doc_id, text, digest, spans in zip(*columns, strict=True):
                if _digest(text) != digest:
                    continue
                if spans:
                    places = [m.start() for m in word.finditer(text)] + [len(text)]
                    at, parts = 0, []
                    for s in spans:
                        parts.append(text[at : places[s["first"]]])
                        at = places[s["last"]]
                    text = "".join([*parts, text[at:]])
                ids.append(doc_id)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    own = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("text"))
    cuts = found.select("doc_id", "digest", "spans").dropDuplicates(["doc_id", "digest"])
    met = own.join(cuts, own["own_id"].eqNullSafe(cuts["doc_id"])).select("doc_id", "text", "digest", "spans")
    return met.mapInArrow(run, "doc_id bigint, text string")
