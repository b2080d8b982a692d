"""Token ids in flat binary files with 64-bit document offsets, read back by memory mapping.

Layout of a folder: for each range of documents ``<part>-<attempt>.ids`` holds nothing but ids, as
little-endian unsigned integers of 16 bits where the vocabulary allows it and of 32 bits elsewhere;
``<part>-<attempt>.idx`` holds, as little-endian signed 64-bit integers, the number of documents n,
n document ids, and n + 1 offsets into the ids.  ``manifest`` is a Parquet table with one row per
part: its files, counts, and the number of documents and ids in all parts before it, which are
prefix sums over the parts' counts.

Documents are range-partitioned by (id, hash of text) and sorted inside a part, so the parts follow
each other in id order.  Each task streams its documents into its own files and reports their
counts; a repeated attempt writes files of another name, and only the files in the manifest count.
The folder must be one that all executors share.

Defined cases: null ids come first and are stored as the least 64-bit integer; rows with the same id
are ordered by the hash of their text; null and empty texts hold the end id alone; an empty table
gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cueloom.llm.unicode_classes import SPACE, byte_symbols, category, odd
from cueloom.shared import ship

CACHED_PIECES = 300_000
TOGETHER = 1 << 22  # bytes of texts that are encoded together
NULL_ID = -(1 << 63)


class _Kept(dict):
    """Ids of pieces, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.make(piece)
        return ids


class PieceEncoder:
    """The tokenizers library behind a cache of pieces.

    A byte-level tokenizer encodes each piece of its splitting pattern by itself, so each distinct
    piece goes to the library's model once.  The pattern parts any other character from a space after
    it and never looks back, so a space and all up to the next one, a run, has the same pieces in every
    text; the texts of a batch are cut at spaces and each distinct run of theirs is parted once.  Texts
    with a special token's string, and tokenizers with any other pre-tokenizer, go to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        known = json.loads(definition)
        before = known.get("pre_tokenizer") or {}
        self.pieces = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not (before.get("add_prefix_space") or known.get("normalizer")):
            letters, digits = category("L"), category("N")
            ends = "'s|'t|'re|'ve|'m|'ll|'d"
            self.pieces = re.compile(
                f"{ends}| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
            ).findall
            # The same pattern in the classes that ``re`` has built in, for texts where those mean the same.
            self.usual = odd().isdisjoint
            self.quick = re.compile(rf"{ends}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
            self.symbol = dict(enumerate(byte_symbols()))
            self.space = self.symbol[ord(" ")]
            self.model = self.tokenizer.model
        self.marks = [t["content"] for t in known.get("added_tokens", ())]
        self.mark = re.compile("|".join(map(re.escape, self.marks))).search if self.marks else None
        self.cache = _Kept(self._ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.pieces is None or (self.mark and self.mark(text)):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        return self._whole(text)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, as ``encode`` gives them."""
        if self.pieces is None:
            yield from map(self.encode, texts.to_pylist())
            return
        part = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False) // TOGETHER
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield from self._together(texts.slice(low, high - low))

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = cut.flatten().dictionary_encode()
        names, run = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        # White space before a space is no run's end: the pattern looks at both together.
        blank = np.array([not name or name[-1].isspace() for name in names], bool)
        ended = blank[run]
        ended[at[1:] - 1] = False
        alone = np.add.reduceat(ended, at[:-1]) > 0 if len(run) else np.empty(0, bool)
        for mark in self.marks:
            alone |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        # A text's first run has no space before it.
        run[at[:-1]] += len(names)
        used = np.flatnonzero(np.bincount(run, minlength=2 * len(names)))
        plain = (used < len(names)) & ~blank[used % max(1, len(names))]
        spaced, others = used[plain], used[~plain]
        ids, length = self._runs([names[n] for n in spaced.tolist()])
        apart = [self._whole(names[n - len(names)] if n >= len(names) else " " + names[n]) for n in others.tolist()]
        flat = np.concatenate([ids, np.frombuffer(b"".join(apart), "<u4")])
        length = np.concatenate([length, np.fromiter(map(len, apart), np.int64, len(apart)) // 4])
        start = np.cumsum(length) - length
        place = np.empty(2 * len(names), np.int64)
        place[np.concatenate([spaced, others])] = np.arange(len(used))
        run = place[run]
        own = length[run]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        packed = flat[np.repeat(start[run] - (ends - own), own) + np.arange(total)].tobytes()
        low = 0
        for k, high in enumerate((4 * ends[at[1:] - 1]).tolist()):
            yield self.encode(texts[k].as_py()) if alone[k] else packed[low:high]
            low = high

    def _runs(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these runs, each with its space, and how many each has."""
        if not names:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        pieces = self._pieces(f" {' '.join(names)}")
        found = list(map(self.cache.__getitem__, pieces))
        # A run has no other space, so a piece with one begins it.
        owner = np.cumsum(np.array([piece[0] == " " for piece in pieces])) - 1
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.bincount(owner, sizes, len(names)).astype(np.int64)

    def _pieces(self, text: str) -> list[str]:
        return self.quick(text) if self.usual(text) else self.pieces(text)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self._pieces(text)))

    def _ids(self, piece: str) -> bytes:
        # Of the printable characters of ASCII only the space has another symbol.
        if piece.isascii() and piece.isprintable():
            symbols = piece.replace(" ", self.space)
        else:
            symbols = piece.encode().decode("latin-1").translate(self.symbol)
        return _packed([token.id for token in self.model.tokenize(symbols)])


def _packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


_here: dict[int, PieceEncoder] = {}


def _encoder(definition: str) -> PieceEncoder:
    """One per worker process, so that its cache outlives a task."""
    key = hash(definition)
    if key not in _here:
        _here.clear()
        _here[key] = PieceEncoder(definition)
    return _here[key]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files; returns the manifest (part, ids_file, idx_file, width, n_docs, n_tokens,
    docs_before, tokens_before)."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    size = max([*json.loads(definition)["model"]["vocab"].values(), end_id]) + 1
    extra = [t["id"] + 1 for t in json.loads(definition).get("added_tokens", ())]
    width = 2 if max([size, *extra]) <= 1 << 16 else 4
    sent = spark.sparkContext.broadcast(definition)
    end = np.array([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, home = fs.FileSystem.from_uri(folder)
        store.create_dir(home, recursive=True)
        ids, offsets = [], [0]
        with store.open_output_stream(f"{home}/{name}.ids") as out:
            for batch in batches:
                ids += batch.column("doc_id").to_pylist()
                for packed in encoder.encode_all(batch.column("text")):
                    if width == 2:
                        packed = np.frombuffer(packed, "<u4").astype("<u2").tobytes()
                    out.write(packed)
                    out.write(end)
                    offsets.append(offsets[-1] + len(packed) // width + 1)
        head = np.array([len(ids), *[NULL_ID if i is None else i for i in ids], *offsets], "<i8")
        with store.open_output_stream(f"{home}/{name}.idx") as out:
            out.write(head.tobytes())
        if ids:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task.partitionId()], pa.int32()), "ids_file": [f"{name}.ids"],
                "idx_file": [f"{name}.idx"], "width": pa.array([width], pa.int32()),
                "n_docs": [len(ids)], "n_tokens": [offsets[-1]],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("digest", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    made = ordered.mapInArrow(
        write, "part int, ids_file string, idx_file string, width int, n_docs bigint, n_tokens bigint"
    )
    made.write.mode("overwrite").parquet(f"{folder}/counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.read.schema(made.schema).parquet(f"{folder}/counts").select(
        "*", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("tokens_before"),
    )
    bases.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where the store is the local file system."""
    if store.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (packed little-endian 32-bit integers)."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                index = _mapped(store, f"{home}/{part['idx_file']}", "<i8")
                ids = _mapped(store, f"{home}/{part['ids_file']}", f"<u{part['width']}")
                n = int(index[0])
                doc_ids, offsets = index[1 : n + 1], index[n + 1 :]
                for low in range(0, n, 500):
                    high = min(low + 500, n)
                    cut = [ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() for k in range(low, high)]
                    own = doc_ids[low:high]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=np.asarray(own == NULL_ID)),
                        "start": pa.array(offsets[low:high] + part["tokens_before"], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[low : high + 1]), pa.int64()),
                        "ids": pa.array(cut, pa.binary()),
                    })

    parts = manifest(spark, folder)
    spread = parts.repartition(max(1, parts.count()), "part")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")

