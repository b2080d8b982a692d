"""Token windows of one length by multiway differencing.

Documents are encoded task by task.  Whole windows of a document stand alone; its rest is cut into
pieces of at most ``largest`` ids and joins a group.  A group is full at ``windows`` times the
capacity, to the id, since the piece at its border is cut there; only the last group of a task may
be shorter.  Inside a group the method of Karmarkar and Karp differences partial partitions: every
piece starts as a partition of its own, and the two with the greatest spread between their fullest
and emptiest part are merged, the fullest parts of one with the emptiest of the other, until one
partition is left.  Its parts are near equal, so as a rule all of them hold; where one exceeds the
capacity the group is parted again into one window more.

A group holds at most ``windows * capacity`` ids, whatever the texts, so a task's memory is bounded
by that and one text.  Nothing is shuffled or written in between: a lost task is run again and makes the
same windows from the same split.  Padding is what near-equal windows lack and at most one window a task.

Defined cases: null and empty texts are the end id alone; null and repeated ids, and repeated rows, are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.token_files import _encoder
from cueloom.shared import ship

#: Sequence ids of a task follow each other from its number times this on.
TASK_IDS = 1 << 40
ROWS = 5_000


def _merged(a: list, b: list, parts: int) -> list:
    """One partition of two: (load, pieces) pairs, fullest first; empty parts are left out."""
    alone = max(parts - len(b), 0)
    meet = [(a[i][0] + b[parts - 1 - i][0], (a[i][1], b[parts - 1 - i][1])) for i in range(alone, len(a))]
    both = a[:alone] + meet + b[: parts - len(a)]
    both.sort(key=lambda part: -part[0])
    return both


def _leaves(tree) -> list[int]:
    """Positions in a tree of pairs, ascending; no recursion, since a tree may be deep."""
    out, open_ = [], [tree]
    while open_:
        top = open_.pop()
        if isinstance(top, int):
            out.append(top)
        else:
            open_ += top
    return sorted(out)


def differenced(sizes: list[int], parts: int) -> list[list[int]]:
    """Positions of ``sizes`` by part; at most ``parts`` parts, none empty."""
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    if parts == 1 or not heap:
        return [list(range(len(sizes)))] if sizes else []
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        made = _merged(a, b, parts)
        spread = made[0][0] - (made[-1][0] if len(made) == parts else 0)
        heapq.heappush(heap, (-spread, number, made))
        number += 1
    return [_leaves(tree) for _, tree in heap[0][2]]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows that differencing finds within the capacity; no size exceeds it."""
    parts = -(-sum(sizes) // capacity)
    while True:
        made = differenced(sizes, parts)
        if all(sum(sizes[i] for i in part) <= capacity for part in made):
            return made
        parts += 1


class _Packer:
    """Pieces of one task: (document, start, length, crc32, ids of the document, sequence, offset)."""

    def __init__(self, first: int, capacity: int, windows: int, largest: int):
        self.next, self.capacity, self.windows, self.largest = first, capacity, windows, min(largest, capacity)
        self.held: list[tuple] = []
        self.room = windows * capacity
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, packed: bytes) -> None:
        total, at = len(packed) // 4, 0
        while total - at >= self.capacity:
            self._place(doc_id, at, packed[4 * at : 4 * (at + self.capacity)], total, 0)
            self.next += 1
            at += self.capacity
        while at < total:
            length = min(total - at, self.largest, self.room)
            self.held.append((doc_id, at, packed[4 * at : 4 * (at + length)], total))
            at += length
            self.room -= length
            if not self.room:
                self.close()

    def close(self) -> None:
        for window in windows_of([len(piece[2]) // 4 for piece in self.held], self.capacity):
            offset = 0
            for i in window:
                self._place(*self.held[i], offset)
                offset += len(self.held[i][2]) // 4
            self.next += 1
        self.held, self.room = [], self.windows * self.capacity

    def _place(self, doc_id: int | None, start: int, ids: bytes, total: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset))

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            columns = [pa.array(column, pa.int64()) for column in zip(*self.rows, strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, NAMES)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, windows: int = 128, largest: int = 256, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (ids of the sequence before it)."""
    if min(capacity, windows, largest) < 1:
        raise ValueError("capacity, windows and largest are at least 1")
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        end = end_id.to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId() * TASK_IDS, capacity, windows, largest)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                packer.add(doc_id, ids + end)
                yield from packer.batches(ROWS)
        packer.close()
        yield from packer.batches(0)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} bigint" for name in NAMES))
