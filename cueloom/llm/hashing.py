"""Stable 64-bit hashes of words, the same in every worker process."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHED = 200_000
_seen: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One uint64 per word; a bounded cache of the process saves hashing common words again."""
    seen = _seen
    if len(seen) > _CACHED:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (the finaliser of a multiply-shift hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries, by position; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = h[:n] * factors[0]
    for i in range(1, k):
        out += h[i : i + n] * factors[i]
    return mix(out)


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def batch_word_hashes(texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
    """``word_hashes`` of all words of the texts, A-Z lowered, and the number of words of each line of each text.

    XXH64 of words under 32 bytes is computed on arrays; no word becomes an object."""
    data, whole, start, end = _placed(texts)
    breaks = np.flatnonzero(np.frombuffer(whole, np.uint8, len(whole) - 8) == 10)
    counts = np.diff(np.searchsorted(start, breaks)).tolist()
    lines, at = [], 0
    for own in data:
        n = own.count(b"\n") + 1
        lines.append(counts[at : at + n])
        at += n
    return _xxh64(whole, start, end - start), lines


def word_counts(texts: list[str | None]) -> np.ndarray:
    """The number of words of each text."""
    data, _, start, _ = _placed(texts)
    ends = np.cumsum([0, *(len(own) + 1 for own in data)])
    return np.diff(np.searchsorted(start, ends + 1))


def _placed(texts: list[str | None]) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    """The texts, all of them in a row with A-Z lowered, and where words begin and end in that."""
    data = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    # White space on both sides of every text, and room to read eight bytes from the last word on.
    whole = b"".join([b"\n", b"\n".join(data), b"\n\0\0\0\0\0\0\0\0"]).lower()
    space = _SPACE[np.frombuffer(whole, np.uint8, len(whole) - 8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return data, whole, edges[::2], edges[1::2]


def _xxh64(whole: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of ``length`` bytes from each ``start``; eight bytes beyond the last can be read."""
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
    four = np.ndarray(len(whole) - 3, "<u4", whole, strides=(1,))
    one = np.frombuffer(whole, np.uint8)
    out = length.astype(np.uint64) + _P5
    for k in range(3):
        own = np.flatnonzero(length >= 8 * k + 8)
        if len(own):
            lane = _turned(eight[start[own] + 8 * k] * _P2, 31) * _P1
            out[own] = _turned(out[own] ^ lane, 27) * _P1 + _P4
    at = start + (length & ~7)
    own = np.flatnonzero(length & 4)
    out[own] = _turned(out[own] ^ (four[at[own]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at += length & 4
    for k in range(3):
        own = np.flatnonzero((length & 3) > k)
        out[own] = _turned(out[own] ^ (one[at[own] + k].astype(np.uint64) * _P5), 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(length >= 32).tolist():
        out[k] = xxhash.xxh64_intdigest(whole[start[k] : start[k] + length[k]])
    return out
