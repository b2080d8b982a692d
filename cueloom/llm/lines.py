"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words.  A line goes if an earlier line has the same words or, among lines of at
least ``MIN_WORDS`` words, lies within one word edit of it (a word changed, added or left out);
"earlier" is the order of first occurrence by (id, text hash, line number).  Shorter lines go only if
equal: in them one word is most of the meaning.

Near lines are found by their deletion neighbourhoods.  Every line emits its own hash and the hash of each
variant with one word left out.  Two lines within one edit share such a key: both as variants with
the same word position left out, or one as itself and the other as a variant.  Lines are joined
to the earliest line of each key and role, never to each other, so a key held by a third of all lines
makes as many pairs as lines; every pair's edit distance is then verified on the words.

Before that, lines that cannot have such a partner are set aside without loss: of two lines within one
edit, either the first half of the shorter or its second half stands unchanged at the same end of the other.
Each line has four such half keys; a line none of whose keys another line shares emits no variants.

Defined cases: null texts stay null and empty ones empty; blank lines stay; repeated rows (same id and
text) are one document and get equal results; null ids sort first; other columns pass through
where ``carry`` names them.  All lines of all documents take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.hashing import mix, word_hashes
from cueloom.llm.jaccard import shared_counts
from cueloom.shared import pin, ship

MIN_WORDS = 8
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The first n powers of the base (sign 1) or of its inverse (-1), modulo 2**64."""
    held = _powers[sign]
    if len(held) < n:
        step = np.full(max(n, 2 * len(held)), np.uint64(_BASE) if sign > 0 else _BACK, np.uint64)
        step[0] = 1
        held = _powers[sign] = np.multiply.accumulate(step)
    return held[:n]


def split_lines(text: str | None) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in text.encode("utf-8", "surrogatepass").split(b"\n")] if text else []


def _prefix_sums(hashed: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * _power(1, len(hashed)), out=sums[1:])
    return sums


def _key(value: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    return mix(value ^ mix(np.atleast_1d(np.asarray(tag)).astype(np.uint64)))


def line_name(words: list[bytes]) -> int:
    """64-bit name of a line's words."""
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)


def half_keys(words: list[bytes]) -> list[int]:
    """The four half keys of a line: as the shorter or equal line, and as the longer by one word."""
    n, keys = len(words), []
    for shorter in (n, n - 1):
        half = shorter // 2
        tail = shorter - half
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 2 * shorter))
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[n - tail :]), 2 * shorter + 1))
    return keys


def variant_keys(hashed: np.ndarray) -> np.ndarray:
    """Keys of the line itself and of the line without its first, second, ... word."""
    n, sums = len(hashed), _prefix_sums(hashed)
    without = sums[:-1] + (sums[n] - sums[1:]) * _BACK
    return np.concatenate([_key(sums[n:], n), _key(without, n - 1)])


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Word edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    head = int(np.argmax(differ)) if differ.any() else n
    differ = a[::-1][:n] != b[::-1][:n]
    tail = int(np.argmax(differ)) if differ.any() else n
    return head + tail >= max(len(a), len(b)) - 1


def _half_pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    long = [words for words in split_lines(text) if len(words) >= MIN_WORDS]
    keys = [key for words in long for key in half_keys(words)]
    return np.repeat(np.array([line_name(words) for words in long], np.int64), 4), np.array(keys, np.uint64)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, at, line): every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows, at, names = [], [], []
                for n, text in enumerate(part.column("text").to_pylist()):
                    found = [(k, line_name(words)) for k, words in enumerate(split_lines(text)) if words]
                    rows += [n] * len(found)
                    at += [k for k, _ in found]
                    names += [name for _, name in found]
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(row), part.column("digest").take(row),
                    pa.array(at, pa.int32()), pa.array(names, pa.int64()),
                ], ["doc_id", "digest", "at", "line"])

    return docs.mapInArrow(run, "doc_id bigint, digest bigint, at int, line bigint")


def _zipped(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with column ``zip`` for ``text``: texts meet their lines' fate in a shuffle, and go there compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(packed, pa.binary())], [*keep, "zip"])

    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kind}, zip binary")


def _unzip(packed: bytes | None) -> str | None:
    return None if packed is None else zlib.decompress(packed).decode("utf-8", "surrogatepass")


def _candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rank, line, words): word hashes of the wanted lines (doc_id, digest, ats).

    ``rank`` grows in the order of first occurrence: lines are sorted, and Spark numbers rows of a sorted
    table in increasing order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "zip", "digest", "ats")]
            for doc_id, packed, digest, ats in zip(*columns, strict=True):
                lines = split_lines(_unzip(packed))
                for k in ats:
                    out.append((doc_id, digest, k, line_name(lines[k]), word_hashes(lines[k]).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            parts = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(parts, kinds, strict=True)], ["doc_id", "digest", "at", "line", "words"]
            )

    sent = _zipped(docs, "doc_id", "digest")
    same = sent["doc_id"].eqNullSafe(wanted["doc_id"]) & (sent["digest"] == wanted["digest"])
    met = sent.join(wanted.hint("merge"), same).select(sent["doc_id"], "zip", sent["digest"], "ats")
    made = met.mapInArrow(run, "doc_id bigint, digest bigint, at int, line bigint, words binary").dropDuplicates(["line"])
    ordered = made.repartitionByRange("doc_id", "digest", "at").sortWithinPartitions("doc_id", "digest", "at")
    return ordered.select(F.monotonically_increasing_id().alias("rank"), "line", "words")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, rank): role -1 for the line itself, else the word position left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                made = [variant_keys(np.frombuffer(w, np.uint64)) for w in part.column("words").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(made).view(np.int64)),
                    pa.array(np.concatenate([np.arange(-1, len(m) - 1, dtype=np.int32) for m in made])),
                    part.column("rank").take(row),
                ], ["key", "role", "rank"])

    return lines.select("rank", "words").mapInArrow(run, "key bigint, role int, rank bigint")


def _near_lines(lines: DataFrame) -> DataFrame:
    """Names of the lines with an earlier line within one edit."""
    members = _variants(lines)
    earliest = members.groupBy("key", "role").agg(F.min("rank").alias("lead")).withColumnRenamed("role", "as")
    pairs = members.join(earliest, "key").filter(
        ((F.col("role") == F.col("as")) | (F.col("role") == -1) | (F.col("as") == -1)) & (F.col("lead") < F.col("rank"))
    ).select("rank", "lead").distinct()
    later = lines.select("rank", "line", F.col("words").alias("one"))
    earlier = lines.select(F.col("rank").alias("lead"), F.col("words").alias("two"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)
            keep = [within_one_edit(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in both]
            yield batch.select(["line"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(later, "rank").join(earlier, "lead")
    return met.select("line", "one", "two").mapInArrow(verify, "line bigint").distinct()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: struct ``own`` (doc_id and the ``carry`` columns), ``text`` without repeated lines,
    ``n_lines`` (lines with a word), ``n_removed``."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.withColumn("digest", F.xxhash64("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = shared_counts(plain, _half_pairs, buckets).select(F.col("sid").alias("line"), F.lit(True).alias("met"))
    first = _occurrences(plain).groupBy("line").agg(F.min(F.struct("doc_id", "digest", "at")).alias("first"))
    lines = pin(first.join(met, "line", "left").select("line", "first.*", F.col("met").isNotNull().alias("met")), "lines")
    wanted = lines.filter("met").groupBy("doc_id", "digest").agg(F.collect_list("at").alias("ats"))
    near = _near_lines(pin(_candidates(plain, wanted), "near"))
    kept = lines.join(near, "line", "left_anti").groupBy("doc_id", "digest").agg(F.collect_list("at").alias("ats"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for packed, ats in zip(batch.column("zip").to_pylist(), batch.column("ats").to_pylist(), strict=True):
                text = _unzip(packed)
                stay, lines_ = set(ats or ()), (text or "").split("\n")
                full = [bool(w) for w in split_lines(text)] or [False]
                out = [line for k, line in enumerate(lines_) if not full[k] or k in stay]
                texts.append(None if text is None else "\n".join(out))
                counts.append(sum(full))
                removed.append(len(lines_) - len(out))
            yield pa.RecordBatch.from_arrays([
                batch.column("own"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())
            ], ["own", "text", "n_lines", "n_removed"])

    full = docs.select(
        F.struct(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in carry]).alias("own"),
        F.col(text_col).cast("string").alias("text"),
    )
    sent = _zipped(full.withColumn("seen", F.xxhash64("text")), "own", "seen")
    same = F.col("own.doc_id").eqNullSafe(kept["doc_id"]) & (F.col("seen") == kept["digest"])
    met = sent.join(kept.hint("merge"), same, "left").select("own", "zip", "ats")
    kind = full.schema["own"].dataType.simpleString()
    return met.mapInArrow(rebuild, f"own {kind}, text string, n_lines bigint, n_removed bigint")
