"""Keys that more than one owner sends, without a row per key.

Keys travel packed by bucket, five bytes and the number of their owner in a list of the owners that the bucket gets
from a batch.  Each task marks what it sees shared by itself and sends such a key once, without an owner: a key that
a third of the owners hold arrives once per task.  ``keys_of`` gives, for parts of a batch, the owners (int64), the
place of an owner among these pair by pair, and the keys (uint64, spread evenly).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

KeysOf = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
_BATCH_KEYS = 500_000  # pairs a worker sorts at once, some 100 bytes each
_LOW = np.uint64(0xFFFFFFFF)


def low_bits(keys: np.ndarray) -> np.ndarray:
    """What ``shared_keys`` returns of keys."""
    return (keys & _LOW).astype("<u4")


def _edges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of sorted keys begin, and their lengths."""
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return edge, np.diff(np.append(edge, len(keys)))


def _by_home(docs: np.ndarray, low: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(home, docs, low) of pairs, by the bucket of the text."""
    home = docs % buckets
    order = np.argsort(home, kind="stable")
    docs, low = docs[order], low[order] if len(low) else low
    ends = np.searchsorted(home[order], np.arange(buckets + 1))
    return [
        (b, docs[ends[b] : ends[b + 1]].tobytes(), low[ends[b] : ends[b + 1]].tobytes())
        for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    ]


def shared_keys(table: DataFrame, keys_of: KeysOf, buckets: int) -> DataFrame:
    """(doc, keys): of each owner the keys that another one sends too or itself twice, packed as ``low_bits``; owners
    without any are not listed.  Five bytes and the bucket may be equal for two keys, so an owner may get a key too
    many, never one too few."""
    return _shared(table, keys_of, buckets, True)


def sharing(table: DataFrame, keys_of: KeysOf, buckets: int) -> DataFrame:
    """(doc): owners with a key that another one sends too; keys are compared whole."""
    return _shared(table, keys_of, buckets, False)


def _shared(table: DataFrame, keys_of: KeysOf, buckets: int, listed: bool) -> DataFrame:
    kept = np.dtype("u1" if listed else "<u4")  # of a key's upper half

    def marked(names: np.ndarray, owner: np.ndarray, keys: np.ndarray, chosen: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        if listed:
            return _by_home(names[owner[chosen]], low_bits(keys[chosen]), buckets)
        found = np.zeros(len(names), bool)
        found[owner[chosen]] = True
        return _by_home(names[found], np.empty(0, "<u4"), buckets)

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, at, number = np.unique(np.concatenate([n for n, _, _ in held]), return_index=True, return_inverse=True)
        base = np.cumsum([0, *(len(n) for n, _, _ in held)])
        place = np.concatenate([rows + b for b, (_, rows, _) in zip(base[:-1], held, strict=True)])
        keys, owner = np.concatenate([k for _, _, k in held]), number[place]
        if listed:
            # A row again is the same owner, not its key twice.
            once = at[owner] == place
            keys, owner = keys[once], owner[once]
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        edge, length = _edges(keys)
        least, most = np.minimum.reduceat(owner, edge), np.maximum.reduceat(owner, edge)
        rows = [
            (buckets + home, low, b"", b"", own)
            for home, own, low in marked(names, owner, keys, np.repeat(length > 1 if listed else least != most, length))
        ]
        keys, owner = keys[edge], np.where(least == most, least, -1)
        ends = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
        for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            k, o = keys[ends[b] : ends[b + 1]], owner[ends[b] : ends[b + 1]]
            known = o >= 0
            own, place = np.unique(o[known], return_inverse=True)
            kind = np.dtype("<u2" if len(own) < 0xFFFF else "<u4")
            places = np.full(len(o), np.iinfo(kind).max, kind)
            places[known] = place
            high = (k >> np.uint64(32)).astype(kept)
            rows.append((b, low_bits(k).tobytes(), high.tobytes(), places.tobytes(), names[own].tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "low", "high", "places", "docs"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in keys_of(batch):
                if len(part[2]):
                    held.append(part)
                    size += len(part[2])
                if size > _BATCH_KEYS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def second(parts: pd.DataFrame) -> pd.DataFrame:
        bucket = int(parts["bucket"].iloc[0])
        if bucket >= buckets:
            return pd.DataFrame({"home": bucket - buckets, "docs": parts["docs"], "low": parts["low"]})
        keys, owners, names, base = [], [], [], 0
        for low, high, places, own in zip(parts["low"], parts["high"], parts["places"], parts["docs"], strict=True):
            keys.append(np.frombuffer(low, "<u4") | np.frombuffer(high, kept).astype(np.uint64) << np.uint64(32))
            kind = np.dtype(f"<u{len(places) // (len(low) // 4)}")
            place = np.frombuffer(places, kind)
            owners.append(np.where(place == np.iinfo(kind).max, -1, place.astype(np.int64) + base))
            names.append(np.frombuffer(own, np.int64))
            base += len(names[-1])
        names, number = np.unique(np.concatenate(names), return_inverse=True)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        owner = np.where(owner < 0, -1, number[owner] if len(number) else -1)
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        edge, length = _edges(key)
        several = np.minimum.reduceat(owner, edge) != np.maximum.reduceat(owner, edge)
        chosen = np.repeat(several, length) & (owner >= 0)
        return pd.DataFrame(marked(names, owner, key, chosen), columns=["home", "docs", "low"])

    def third(parts: pd.DataFrame) -> pd.DataFrame:
        docs = np.concatenate([np.frombuffer(d, np.int64) for d in parts["docs"]])
        if not listed:
            return pd.DataFrame({"doc": np.unique(docs)})
        low = np.concatenate([np.frombuffer(k, "<u4") for k in parts["low"]])
        order = np.lexsort((low, docs))
        docs, low = docs[order], low[order]
        new = np.append(True, (docs[1:] != docs[:-1]) | (low[1:] != low[:-1]))
        docs, low = docs[new], low[new]
        edge, length = _edges(docs)
        return pd.DataFrame({
            "doc": docs[edge], "keys": [low[a : a + n].tobytes() for a, n in zip(edge.tolist(), length.tolist(), strict=True)]
        })

    packed = table.mapInArrow(first, "bucket int, low binary, high binary, places binary, docs binary")
    marked = packed.groupBy("bucket").applyInPandas(second, "home int, docs binary, low binary")
    return marked.groupBy("home").applyInPandas(third, "doc bigint, keys binary" if listed else "doc bigint")
