"""BPE encoding and decoding with a contiguous rank array per word.

A vocabulary file of the word-level byte BPE kind (``model.vocab``, ``model.merges``, an end-of-word
suffix) is read on the driver and sent to the workers.  A text is put into composed normal form and
lower case, parted into words, and each word into byte symbols, the last with the suffix.  For one
word the parts between boundaries and the ranks of adjacent parts lie in two plain arrays: the least
rank is found by a scan, the boundary there deleted, the two neighbouring ranks refreshed, until no
rank is left.  Words of more than ``LONG`` symbols use a heap over linked parts instead, which gives
the same merges without a quadratic scan.  Encoded words are kept in a bounded cache per process.

Strings of special tokens inside a text are those tokens, as the tokenizers library reads them.
Decoding joins the token strings with spaces, as that library does for a file without a decoder.

Defined cases: null and empty texts have no ids and decode to the empty string; null id arrays
decode like empty ones; repeated rows each get a row; columns named like the results are replaced.
Nothing is shuffled: every text is encoded whole where it is read.
"""

from __future__ import annotations

import array
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from cueloom.llm.unicode_classes import SPACE, byte_symbols, category, new_characters, odd
from cueloom.shared import ship

LONG = 200
CACHED_WORDS = 100_000  # some 250 bytes each
SLICE = 500  # rows whose results are held at once
_NONE = 1 << 30


class RankBpe:
    """The tables of a vocabulary file; picklable, so that a broadcast carries it."""

    def __init__(self, definition: dict):
        model = definition["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 20 | vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in definition.get("added_tokens", ())}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        # Asked of the library once, here, and not by every worker.
        letters, digits, new = category("L"), category("N"), new_characters()
        self.word_class = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+"
        self.new_class = f"[{new}]" if new else None
        self.odd = odd()
        self.normalizer = json.dumps(definition.get("normalizer"))
        self._cache: dict[str, bytes] = {}
        self._word = self._quick = self._mark = self._new = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}, "_word": None, "_quick": None, "_mark": None, "_new": None}

    def word(self, word: str) -> list[int]:
        """Ids of one word by the rank array."""
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        if len(parts) > LONG:
            return self._long(parts)
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 20 | parts[at + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: candidates in a heap, parts linked both ways."""
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        waiting: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            to = after[at]
            if to >= 0 and (r := self.rank.get(parts[at] << 20 | parts[to])) is not None:
                heapq.heappush(waiting, (r, at, parts[at], parts[to]))

        for at in range(n - 1):
            offer(at)
        while waiting:
            r, at, left, right = heapq.heappop(waiting)
            to = after[at] if alive[at] else -1
            if to < 0 or parts[at] != left or parts[to] != right:
                continue
            parts[at], alive[to], after[at] = self.merged[r], False, after[to]
            if after[to] >= 0:
                before[after[to]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._word is None:
            self._word = re.compile(self.word_class).findall
            # The same words in the classes that ``re`` has built in, for texts where those mean the same.
            self._quick = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
            self._new = re.compile(self.new_class).search if self.new_class else lambda word: None
            marks = sorted(self.special, key=len, reverse=True)
            self._mark = re.compile("|".join(f"({re.escape(m)})" for m in marks)) if marks else None
        if self._mark is None or not self._mark.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self._mark.finditer(text):
            out += [self._plain(text[at : found.start()]), self.special[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        low, cache = text.lower(), self._cache
        words = self._quick(low) if self.odd.isdisjoint(low) else self._word(low)
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            pass
        if len(cache) > CACHED_WORDS:
            cache.clear()
        unseen = set(words).difference(cache)
        if any(not w.isprintable() and self._new(w) for w in unseen):
            # Case and composition of characters newer than this Python are the library's to know.
            words = self._word(_normalized(self.normalizer, text))
            return b"".join(_packed(self.word(w)) for w in words)
        for w in unseen:
            cache[w] = _packed(self.word(w))
        return b"".join(map(cache.__getitem__, words))


def _normalized(normalizer: str, text: str) -> str:
    from tokenizers import Tokenizer, models

    whole = Tokenizer(models.BPE())
    definition = json.loads(whole.to_str()) | {"normalizer": json.loads(normalizer)}
    return Tokenizer.from_str(json.dumps(definition)).normalizer.normalize_str(text)


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def joined(tokens: list[str], ids: bytes | None) -> str:
    """The token strings of packed ids, parted by spaces."""
    return " ".join(map(tokens.__getitem__, array.array("I", ids or b"")))


def load(path: str) -> RankBpe:
    with open(path, encoding="utf-8") as file:
        return RankBpe(json.load(file))


_here: dict[int, RankBpe] = {}


def _tables(sent) -> RankBpe:
    """One copy per worker process, so that its cache of words outlives a task."""
    if sent.value is not _here.get(0):
        _here[0] = sent.value
    return _here[0]


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, kind)])


def _mapped(df: DataFrame, source: str, name: str, kind, apply) -> DataFrame:
    """``df`` with column ``name`` = apply(source) in place of any column of that name."""
    keep = [f.name for f in df.schema.fields if f.name != name]
    arrow = pa.large_binary() if isinstance(kind, BinaryType) else pa.large_string()
    narrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                made = pa.array(map(apply, part.column("__source").to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], made.cast(narrow)], names=[*keep, name]
                )

    fed = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source"))
    return fed.mapInArrow(run, _with(df, name, kind))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the ids of ``text_col``, packed as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return _mapped(typed, text_col, ids_col, BinaryType(), lambda text: _tables(sent).encode(text))


def decode(ids: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``ids`` with ``text_col``: the token strings joined by spaces."""
    ship(ids.sparkSession)
    sent = ids.sparkSession.sparkContext.broadcast(load(path).tokens)
    return _mapped(ids, ids_col, text_col, StringType(), lambda packed: joined(sent.value, packed))
