"""Plain versions of the operators, written for small tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import xxhash

SPACES = b" \t\n\x0b\x0c\r"


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    return (text or "").encode().split()


def base_rules(text):
    own = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(own)
    chars = sum(len(w.decode()) for w in own)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, chars, symbols, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def grams(text, buckets):
    own = words(text)
    one = [xxhash.xxh64_intdigest(w, 42) for w in own]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, own[1:], strict=False)]
    return [h % buckets for h in one + two]


def quality_scores(rows, trusted, buckets):
    """Score of each (doc_id, text) row in order."""
    raw, target = Counter(), Counter()
    for doc_id, text in rows:
        own = grams(text, buckets)
        raw.update(own)
        if doc_id in trusted:
            target.update(own)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = [
        math.log((target[b] + 1) / (n_target + buckets)) - math.log((raw[b] + 1) / (n_raw + buckets)) for b in range(buckets)
    ]
    return [sum(ratio[b] for b in own) / len(own) if (own := grams(text, buckets)) else None for _, text in rows]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    m = min(len(a), len(b))
    head = next((i for i in range(m) if a[i] != b[i]), m)
    tail = next((i for i in range(m) if a[-1 - i] != b[-1 - i]), m)
    return head + tail >= max(len(a), len(b)) - 1


def dedup_lines(rows, least=8):
    """New text of each (doc_id, text) row; order of occurrence is (id, Spark's hash of the text, line)."""
    def place(row):
        doc_id, text = row
        digest = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
        return (doc_id is not None, doc_id or 0, digest - (1 << 64) if digest >= 1 << 63 else digest)

    first, order = {}, []
    for row in sorted(rows, key=place):
        for k, line in enumerate((row[1] or "").split("\n")):
            own = tuple(line.encode().split())
            if own and own not in first:
                first[own] = (place(row), k)
                order.append(own)
    gone, longer = set(), []
    for own in order:
        if len(own) >= least:
            if any(one_edit(own, other) for other in longer):
                gone.add(own)
            longer.append(own)
    out = []
    for row in rows:
        if row[1] is None:
            out.append((None, 0, 0))
            continue
        kept, n, removed = [], 0, 0
        for k, line in enumerate(row[1].split("\n")):
            own = tuple(line.encode().split())
            n += bool(own)
            if own and (own in gone or first[own] != (place(row), k)):
                removed += 1
            else:
                kept.append(line)
        out.append(("\n".join(kept), n, removed))
    return out


def shingle_set(text, k=5):
    own = [w.lower() for w in words(text)]
    if not own:
        return frozenset()
    return frozenset([tuple(own)] if len(own) < k else [tuple(own[i : i + k]) for i in range(len(own) - k + 1)])


def components(rows):
    """(size, component) of each (doc_id, text) row, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        met = Counter(j for s in own for j in holders[s])
        for j, n in met.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(len(own), least.get(find(i)) if own else rows[i][0], find(i) if own else None) for i, own in enumerate(sets)]


FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def contamination(text, items, window=13):
    """(n_words, hit positions, item ids with windows)."""
    own = (text or "").encode().translate(FOLD).split()
    hit, met = set(), set()
    for item_id, item in items:
        target = (item or "").encode().translate(FOLD).split()
        n = min(window, len(target))
        if n:
            starts = {tuple(target[k : k + n]) for k in range(len(target) - n + 1)}
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in starts:
                    hit |= set(range(k, k + n))
                    met.add(str(item_id) if item_id is not None else "null")
    return len(own), hit, met
