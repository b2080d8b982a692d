"""Ranked lexical search over block-max inverted lists.

**Index.**  A first pass counts the documents with terms and all their terms, on which scores depend.  In
the second, each task cuts its documents into shards of bounded size and writes one row per shard and
term: the number of documents, the greatest impact in the list, and the list in blocks of ``BLOCK``
documents.  The heads of the blocks (last document, greatest impact, place) lie apart from the packed
blocks, so that a block can be passed over without unpacking it.  A shard also has one row with its
documents' ids and length measures.  Shards are sorted by document id.

**Search.**  Queries go out in blocks of a bounded number of (query, term) rows.  The lists a block
asks for are dealt by shard, and each shard answers every query of the block with Block-Max MaxScore: lists are
ordered by their bounds, the longest run of them whose bounds together do not beat the heap is
non-essential, and only documents of the other lists are candidates.  A candidate goes on to a non-essential
list only while its score so far, the block maximum there and the bounds of the lists after it beat the
heap; blocks without such a candidate stay packed.  Documents are taken in stretches of ascending ids with numpy,
and the split into essential lists is renewed for each.  As ids ascend, a document that only equals the
heap's last score comes after it.  The shards' heaps are merged by a ranking that Spark starts before
the shuffle.

Bounded memory: a shard, one stretch, and the lists of one shard for one block of queries.

Defined cases: null and empty texts hold no terms and count as no documents; repeated rows and ids are
documents of their own and get ranks of their own; null ids rank behind others of the same score; queries with
the same id, null included, are one query; a query without terms or hits gives no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from cueloom.shared import fresh_path, pin, ship

BLOCK = 128
SHARD_DOCS = 16_384
SHARD_TERMS = 4_000_000
STRETCH = 4_096
QUERY_ROWS = 200_000
NULL_ID = (1 << 63) - 1
SLICE = 1 << 20
HEAD = np.dtype([("last", "<i4"), ("top", "<i8"), ("at", "<i4"), ("n", "<i4"), ("doc_bytes", "u1"), ("tf_bytes", "u1")])
ONE_HEAD = struct.Struct("<iqiiBB").pack

#: Bytes to lower case; what is no part of a term becomes a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms in order, in lists of a bounded number of bytes."""
    data = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def impacts(tf: np.ndarray, measure: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * measure)


def measures(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Length measure of each document, 100 for one of mean length."""
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes a value, and the packed values."""
    top = int(values.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return width, values.astype(f"<u{width}").tobytes()


def _pack(docs: np.ndarray, tf: np.ndarray, impact: np.ndarray, block: int) -> tuple[bytes, bytes]:
    """Heads and blocks of one list."""
    n = len(docs)
    heads, body, at = np.zeros(-(-n // block), HEAD), [], 0
    for k in range(len(heads)):
        own = slice(k * block, min((k + 1) * block, n))
        steps = docs[own].copy()
        steps[1:] -= docs[own][:-1]
        steps[0] -= docs[own.start - 1] if k else 0
        (doc_bytes, a), (tf_bytes, b) = _narrow(steps), _narrow(tf[own])
        heads[k] = (docs[own.stop - 1], impact[own].max(), at, own.stop - own.start, doc_bytes, tf_bytes)
        body += [a, b]
        at += len(a) + len(b)
    return heads.tobytes(), b"".join(body)


class PackedList:
    """A list whose blocks are unpacked one by one, when asked for."""

    def __init__(self, heads: bytes, body: bytes, measure: np.ndarray):
        self.heads, self.body, self.measure = np.frombuffer(heads, HEAD), body, measure
        self.last, self.tops = self.heads["last"].astype(np.int64), self.heads["top"].astype(np.int64)
        self.top = int(self.tops.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block ``k``."""
        if k not in self.open:
            _, _, at, n, doc_bytes, tf_bytes = self.heads[k].item()
            docs = np.cumsum(np.frombuffer(self.body, f"<u{doc_bytes}", n, at), dtype=np.int64)
            docs += self.last[k - 1] if k else 0
            tf = np.frombuffer(self.body, f"<u{tf_bytes}", n, at + n * doc_bytes).astype(np.int64)
            self.open[k] = docs, impacts(tf, self.measure[docs])
        return self.open[k]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` up to ``high`` and their impacts."""
        first, end = np.searchsorted(self.last, [low, high - 1])
        cut = [self.block(k) for k in range(first, min(end + 1, len(self.last)))]
        if not cut:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, impact = (cut[0] if len(cut) == 1 else tuple(map(np.concatenate, zip(*cut, strict=True))))
        a, b = np.searchsorted(docs, [low, high])
        return docs[a:b], impact[a:b]


def best(lists: list[tuple[int, PackedList]], k: int, n_docs: int, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) of one shard for a query's (weight, list) pairs."""
    lists = sorted((pair for pair in lists if pair[0] > 0), key=lambda pair: pair[0] * pair[1].top)
    bounds = [0, *itertools.accumulate(weight * one.top for weight, one in lists)]
    heap: list[tuple[int, int]] = []  # (score, -document), worst first
    for low in range(0, n_docs, stretch):
        high = min(low + stretch, n_docs)
        least = heap[0][0] if len(heap) == k else 0
        split = int(np.searchsorted(bounds, least, "right")) - 1
        if split >= len(lists):
            break
        score = np.zeros(high - low, np.int64)
        for weight, one in lists[split:]:
            docs, impact = one.between(low, high)
            score[docs - low] += weight * impact
        left = np.flatnonzero(score + bounds[split] > least)
        left = left[score[left] > 0]
        for j in range(split - 1, -1, -1):
            weight, one = lists[j]
            where = np.searchsorted(one.last, left + low)
            inside = where < len(one.last)
            block_bound = np.where(inside, one.tops[np.minimum(where, len(one.tops) - 1)], 0) * weight
            on = score[left] + block_bound + bounds[j] > least
            left, where, inside = left[on], where[on], inside[on]
            if not len(left):
                break
            for b in np.unique(where[inside]).tolist():
                docs, impact = one.block(b)
                own = left[where == b] + low
                at = np.minimum(np.searchsorted(docs, own), len(docs) - 1)
                held = docs[at] == own
                score[own[held] - low] += weight * impact[at[held]]
            left = left[score[left] + bounds[j] > least]
        found = score[left]
        if len(found) > k:
            left = np.sort(left[np.lexsort((left, -found))[:k]])
            found = score[left]
        for value, doc in zip(found.tolist(), (left + low).tolist(), strict=True):
            if len(heap) < k:
                heapq.heappush(heap, (value, -doc))
            elif value > heap[0][0]:
                heapq.heapreplace(heap, (value, -doc))
    return [(value, -doc) for value, doc in heap]


INDEX = "shard bigint, term binary, n_docs bigint, top bigint, heads binary, body binary"


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard_docs: int = SHARD_DOCS,
    shard_terms: int = SHARD_TERMS,
) -> tuple[DataFrame, int, int]:
    """The index, written to the shared folder, with the numbers of documents with terms and of terms.

    A shard is closed with the document that reaches ``shard_docs`` documents or ``shard_terms`` terms.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = sum(map(len, terms_of(text.as_py())))
                held += n > 0
                terms += n
        yield pa.RecordBatch.from_pydict({"held": [held], "terms": [terms]})

    n_docs, n_terms = rows.select("text").mapInArrow(count, "held bigint, terms bigint").agg(
        F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))
    ).first()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(TaskContext.get().partitionId() << 32, n_docs, n_terms, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if len(shard.ids) >= shard_docs or shard.n >= shard_terms:
                    yield from shard.rows()
        yield from shard.rows()

    path = fresh_path(spark, "lists")
    rows.mapInArrow(index, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path), n_docs, n_terms


class _Shard:
    """Documents of a task until a shard is full."""

    def __init__(self, number: int, n_docs: int, n_terms: int, block: int):
        self.number, self.n_docs, self.n_terms, self.block = number, n_docs, n_terms, block
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.of: defaultdict[bytes, int] = defaultdict()
        self.of.default_factory = self.of.__len__
        self.chunks: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        before = self.n
        for words in terms_of(text):
            self.chunks.append(np.fromiter(map(self.of.__getitem__, words), np.int32, len(words)))
            self.n += len(words)
        if self.n > before:
            self.ids.append(NULL_ID if doc_id is None else doc_id)
            self.lengths.append(self.n - before)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.concatenate(self.chunks).astype(np.int64) * len(ids) + np.repeat(place, lengths)
        self.chunks = []
        pairs, tf = np.unique(pairs, return_counts=True)
        owner, doc = np.divmod(pairs, len(ids))
        measure = measures(lengths[order], self.n_docs, self.n_terms)
        impact = impacts(tf, measure[doc])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        # Lists of one block, which nearly all are, are cut out of two arrays packed at once.
        steps = np.diff(doc, prepend=0)
        steps[starts] = doc[starts]
        (doc_bytes, packed_docs), (tf_bytes, packed_tf) = _narrow(np.maximum(steps, 0)), _narrow(tf)
        last = doc[np.append(starts[1:], len(doc)) - 1].tolist()
        tops = np.maximum.reduceat(impact, starts).tolist()
        ends = [*starts[1:].tolist(), len(owner)]
        terms = list(self.of)
        made: tuple[list, ...] = ([b""], [len(ids)], [0], [ids[order].tobytes()], [measure.tobytes()])
        for k, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True)):
            if b - a <= self.block:
                heads = ONE_HEAD(last[k], tops[k], 0, b - a, doc_bytes, tf_bytes)
                body = packed_docs[doc_bytes * a : doc_bytes * b] + packed_tf[tf_bytes * a : tf_bytes * b]
            else:
                heads, body = _pack(doc[a:b], tf[a:b], impact[a:b], self.block)
            made[0].append(terms[k])
            made[1].append(b - a)
            made[2].append(tops[k])
            made[3].append(heads)
            made[4].append(body)
            if len(made[0]) == 4_096 or b == len(owner):
                yield self._batch(made)
                made = ([], [], [], [], [])
        self.number += 1
        self._clear()

    def _batch(self, made: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array([self.number] * len(made[0]), pa.int64()), *map(pa.array, made, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n_docs", "top", "heads", "body"])


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times), one row per term of a query."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                for words in terms_of(text.as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(words), batch.schema.field(0).type), pa.array(words, pa.binary())], ["item_id", "term"]
                    )

    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(split, f"item_id {kind}, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 20, block_rows: int = QUERY_ROWS, stretch: int = STRETCH) -> DataFrame:
    """(item_id, rank, doc_id, score) of each query's best documents; ``queries`` as from ``query_terms``."""
    spark = index.sparkSession
    ship(spark)
    lists = index.filter("term <> X''")
    asked = queries.select("term").distinct()
    df = lists.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighed = queries.join(df, "term").select("item_id", "term", (
        F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
    ).alias("weight")).filter("weight > 0")
    # Queries are numbered by their rows, so that a block has at most ``block_rows`` rows or is one query.
    sizes = weighed.groupBy("item_id").agg(F.count("*").alias("own"))
    placed = pin(weighed.join(_blocks(sizes, block_rows), F.col("item_id").eqNullSafe(F.col("of")), "inner").drop("of"), "queries")
    kind = queries.schema["item_id"].dataType.simpleString()
    found = None
    for (block,) in placed.select("block").distinct().sort("block").toLocalIterator():
        held = placed.filter(F.col("block") == block).select("item_id", "term", "weight").collect()
        one = _answer(index, held, queries.schema["item_id"], k, stretch)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("place") != NULL_ID, F.col("place")).alias("doc_id"), "score")


def _blocks(sizes: DataFrame, block_rows: int) -> DataFrame:
    """(of, block): queries dealt by their digest to so many blocks that one has about half of ``block_rows`` rows."""
    rows = sizes.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * rows // block_rows)) if rows > block_rows else 1
    return sizes.select(F.col("item_id").alias("of"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))


def _answer(index: DataFrame, held: list[Row], item: T.StructField, k: int, stretch: int) -> DataFrame:
    """Every shard's best documents for one block of queries."""
    spark = index.sparkSession
    asked = defaultdict(list)
    for row in held:
        asked[row.item_id].append((bytes(row.term), row.weight))
    sent = spark.sparkContext.broadcast(list(asked.items()))
    terms = spark.createDataFrame([(b"",), *((t,) for t in {bytes(row.term) for row in held})], "term binary")
    kind = to_arrow_type(item.dataType)

    def shard(rows: pa.Table) -> pa.Table:
        lists = {row["term"]: row for row in rows.to_pylist()}
        own = lists.pop(b"")
        ids, measure = np.frombuffer(own["heads"], np.int64), np.frombuffer(own["body"], np.int64)
        opened = {term: PackedList(row["heads"], row["body"], measure) for term, row in lists.items()}
        items, places, scores = [], [], []
        for name, pairs in sent.value:
            for score, doc in best([(weight, opened[term]) for term, weight in pairs if term in opened], k, len(ids), stretch):
                items.append(name)
                places.append(int(ids[doc]))
                scores.append(score)
        return pa.table({"item_id": pa.array(items, kind), "place": pa.array(places, pa.int64()), "score": pa.array(scores, pa.int64())})

    dealt = index.join(F.broadcast(terms), "term", "left_semi").groupBy("shard")
    return dealt.applyInArrow(shard, f"item_id {item.dataType.simpleString()}, place bigint, score bigint")
