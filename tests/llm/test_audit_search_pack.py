"""Filter audit, ranked search and packing against plain versions on the awkward table."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tables
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueloom.llm import filters, packing, search

ROWS = tables.rows()
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    made = tables.frame(spark, ROWS).repartition(3)
    return made.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return tables.frame(spark, []).limit(0)


def conditions():
    n = F.size("words")
    return {"A": n < 30, "B": 100 * F.size(F.array_distinct("words")) < 90 * n, "C": F.col("text").rlike("[A-Z]")}


LABELS = [(6, 1, 0), (6, 0, 1), (7, 1, None), (3, None, 1), (None, 1, 1), (11, 0, 0), (17, 1, 1)]


def plain_audit(rows):
    """rows: (part, doc_id, failed names)"""
    good = {d for d, q, _ in LABELS if d is not None and q == 1}
    toxic = {d for d, _, t in LABELS if d is not None and t == 1}
    shapley, out = Counter(), {}
    for part in {p for p, _, _ in rows}:
        own = [(d, f) for p, d, f in rows if p == part]
        for order in itertools.permutations("ABCE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                shapley[part, name] += len(gone)
                failing = sum(name in f for _, f in own)
                only = sum(f == {name} for _, f in own)
                out[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), only, sum(d in good for d in gone), sum(d in toxic for d in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, docs, empty):
    least = {}
    for d, t in ROWS:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t in ROWS:
        words = re.findall("[^ \t-\r]+", t or "")
        failed = {"A"} if len(words) < 30 else set()
        failed |= {"B"} if 100 * len(set(words)) < 90 * len(words) else set()
        failed |= {"C"} if re.search("[A-Z]", t or "") else set()
        failed |= {"E"} if d is not None and d > least[t or ""] else set()
        rows.append(("" if d is None or d % 3 == 2 else "ab"[d % 3], d, failed))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    made = filters.audit_filters(docs, conditions(), labels, copies="E")
    got = {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in made.collect()
    }
    assert len(got) == made.count() == 3 * 24 * 4
    assert got == plain_audit(rows)
    assert filters.audit_filters(empty, conditions(), labels, copies="E").count() == 0
    clean = filters.audit_filters(docs, {"N": F.lit(False)}, labels.limit(0))
    assert {(r.kept > 0, r.removed, r.shapley) for r in clean.collect()} == {(True, 0, 0)}
    with pytest.raises(ValueError):
        filters.audit_filters(docs, {}, labels)


def plain_search(rows, queries, k):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(Counter)
    for item, text in queries:
        asked[item].update(TERM.findall((text or "").translate(LOWER)))
    out = Counter()
    for item, terms in asked.items():
        found = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                for w, times in terms.items() if c[w]
            )
            if score > 0:
                found.append((-score, math.inf if d is None else d))
        for rank, (score, d) in enumerate(sorted(found)[:k], 1):
            out[item, rank, None if d == math.inf else d, -score] += 1
    return out


@pytest.mark.parametrize(("block", "stretch", "shard_docs", "rows", "k"), [(2, 3, 7, 12, 3), (128, 4096, 16384, 10**6, 5), (3, 5, 1, 10**6, 1)])
def test_search(spark, docs, empty, block, stretch, shard_docs, rows, k):
    texts = dict(ROWS)
    queries = [(1, texts[6]), (2, texts[12]), (3, "one TWO three absentterm one"), (4, None), (5, ""), (None, texts[15]), (1, texts[21][:900]), (7, "²İ 日本語")]
    items = spark.createDataFrame(queries, "item_id bigint, text string")
    index, n_docs, _ = search.build_index(docs, block=block, shard_docs=shard_docs)
    made = search.search(index, n_docs, search.query_terms(items), k, rows, stretch)
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in made.collect())
    assert got == plain_search(ROWS, queries, k)
    bare, n, _ = search.build_index(empty)
    assert search.search(bare, n, search.query_terms(items)).count() == 0
    assert search.search(index, n_docs, search.query_terms(items.limit(0))).count() == 0


def test_blocks_stay_packed():
    """Once the heap is full, blocks whose maximum cannot beat it are not unpacked."""
    import numpy as np

    measure = np.full(4000, 100)
    docs = np.arange(4000)
    tf = np.where(docs < 20, 90, 1)
    common = search.PackedList(*search._pack(docs, tf, search.impacts(tf, measure), 128), measure)
    few = np.arange(0, 4000, 40)
    ones = np.ones(len(few), np.int64)
    rare = search.PackedList(*search._pack(few, ones, search.impacts(ones, measure[few]), 128), measure)
    found = search.best([(10, rare), (9, common)], 1, 4000, stretch=100)
    want = max((10 * int(search.impacts(1, 100)) * (d % 40 == 0) + 9 * int(search.impacts(int(tf[d]), 100)), -d) for d in range(4000))
    assert found == [(want[0], -want[1])]
    assert len(common.open) < len(common.heads) / 2


def test_pack(spark, docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in ROWS]
    for capacity, windows, largest in ((64, 4, 16), (1024, 128, 256), (1, 1, 1)):
        made = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity, windows, largest).collect()
        pieces, loads = defaultdict(list), defaultdict(list)
        for r in made:
            pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
            loads[r.sequence_id].append((r.offset, r.length))
        wanted = defaultdict(list)
        for d, own in ids:
            wanted[d, len(own)].append(own)
        assert pieces.keys() == wanted.keys()
        for key, owns in wanted.items():
            cover = Counter(i for start, length, _ in pieces[key] for i in range(start, start + length))
            assert cover == Counter({i: len(owns) for i in range(key[1])})
            crcs = {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[s : s + n])) for own in owns for s, n, _ in pieces[key]}
            assert {c for _, _, c in pieces[key]} <= crcs
        for own in loads.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        if capacity == 64:
            full = sum(len(own) for _, own in ids)
            assert len(loads) * capacity < 1.06 * full + 3 * capacity
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_differencing():
    """Known sets, and windows that hold whatever the sizes."""
    parts = packing.differenced([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    for sizes in ([], [5], [3] * 50, [1024] * 9, [1, 1023, 512, 512, 700, 324], list(range(1, 200))):
        made = packing.windows_of(sizes, 1024)
        assert sorted(i for part in made for i in part) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in part) <= 1024 for part in made)
    assert len(packing.windows_of([1024] * 9, 1024)) == 9
    assert len(packing.windows_of([700, 700, 700], 1024)) == 3
    assert packing._leaves(((0, (1, 2)), 3)) == [0, 1, 2, 3]
