"""Texts cut together, the keys they share, and what is left of tables made meanwhile."""

import pathlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from test_passages import edited, frame, line

from cueloom.llm import components, jaccard, paragraphs
from cueloom.llm.hashing import batch_word_hashes, word_counts
from cueloom.llm.shared_keys import low_bits, shared_keys, sharing
from cueloom.shared import shared_dir, ship


def odd_texts(rng, n):
    texts = [None, "", " \n ", "One", "é\tÉ\x0bx", "a b c d", "一" * 40]
    for _ in range(n):
        words = [f"{rng.choice('aBé')}{rng.randrange(rng.choice([1, 3, 900]))}" * rng.choice([1, 1, 1, 9]) for _ in range(rng.randrange(90))]
        texts.append("".join(w + rng.choice([" "] * 9 + ["\n", "\n\n", "\r\n", "  "]) for w in words))
    rng.shuffle(texts)
    return texts


def test_words_of_many_texts():
    """Hashes and line sizes as those of split words."""
    texts = odd_texts(random.Random(21), 80)
    hashed, lines = batch_word_hashes(texts)
    own = [[line.split() for line in (t or "").encode().lower().split(b"\n")] for t in texts]
    assert lines == [[len(line) for line in text] for text in own]
    assert word_counts(texts).tolist() == [sum(map(len, text)) for text in own]
    assert hashed.tolist() == [xxhash.xxh64_intdigest(w) for text in own for line in text for w in line]


def test_units_do_not_depend_on_the_texts_beside():
    texts = odd_texts(random.Random(22), 60)
    made = paragraphs.units(texts)
    for k, text in enumerate(texts):
        alone, at = paragraphs.units([text]), np.flatnonzero(made.row == k)
        for field, there in (("begins", "begins"), ("n", "n"), ("names", "names"), ("keys", "keys"), ("cuts", "cuts")):
            assert np.array_equal(getattr(made, field)[at], getattr(alone, there))
        assert made.packed(at) == [alone.tokens(j).tobytes() for j in range(len(at))]


def test_shared_keys_by_brute_force(spark):
    def parts(batch):
        keys = batch.column("keys")
        counts = np.diff(keys.offsets.to_numpy())
        yield batch.column("doc").to_numpy(), np.repeat(np.arange(len(counts)), counts), keys.flatten().to_numpy().view(np.uint64)

    ship(spark)
    rng = random.Random(23)
    spread = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    rows = [(k, [rng.choice(spread) for _ in range(rng.randrange(6))]) for k in range(200)] + [(1000, [5, 5]), (1001, [spread[0]] * 2)]
    rows += rows[:10]
    table = spark.createDataFrame(rows, "doc long, keys array<long>").repartition(3)
    holders, own = {}, dict(rows)
    for doc, keys in rows:
        for k in keys:
            holders.setdefault(k, set()).add(doc)
    found = {r.doc: set(np.frombuffer(r["keys"], "<u4").tolist()) for r in shared_keys(table, parts, 4).collect()}
    low = lambda k: int(low_bits(np.array([k], np.int64).view(np.uint64))[0])
    want = {doc: {low(k) for k in keys if len(holders[k]) > 1 or keys.count(k) > 1} for doc, keys in own.items()}
    assert found == {doc: keys for doc, keys in want.items() if keys}
    other = sorted(doc for doc, keys in own.items() if any(len(holders[k]) > 1 for k in keys))
    assert sorted(r.doc for r in sharing(table, parts, 4).collect()) == other


def test_few_sets_link_as_many():
    rng = random.Random(24)
    counts = [rng.randint(2, jaccard.FEW) for _ in range(40)]
    sets = []
    for c in counts:
        base = rng.sample(range(90), 24)
        sets += [np.array(sorted(rng.sample(base, rng.randint(17, 24))), np.uint64) for _ in range(c)]
    pairs = set(zip(*(x.tolist() for x in jaccard.link_few(np.array(counts), sets, 3, 4)), strict=True))
    ends = np.cumsum(counts).tolist()
    want = set()
    for low, high in zip([0, *ends], ends, strict=False):
        for a in range(low, high):
            for b in range(a + 1, high):
                both, either = np.intersect1d(sets[a], sets[b]), np.union1d(sets[a], sets[b])
                want |= {(a, b)} if 4 * len(both) >= 3 * len(either) else set()
    assert pairs == want and want


def test_components_at_once_as_in_rounds(spark, monkeypatch):
    rng = random.Random(27)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(None, 1), (5, 5)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    at_once = sorted(map(tuple, components.components(table).collect()))
    monkeypatch.setattr(components, "ONCE", 0)
    assert at_once == sorted(map(tuple, components.components(table).collect())) and (260, 200) in at_once
    assert components.components(table.filter("a = b")).collect() == []


def test_places_without_a_shared_key_make_no_row(spark):
    """Of texts without repeats nothing is kept; of near copies only their own places are."""
    rng = random.Random(25)
    base = line(rng, 90)
    texts = [line(rng, 120) for _ in range(20)] + [f"{line(rng, 60)}\n\n{t}" for t in (base, edited(base, 45))]
    docs = frame(spark, texts).selectExpr("doc_id AS doc", "doc_id", "text")
    ship(spark)
    asked = shared_keys(docs.select("doc", "text"), paragraphs._sent_keys, 4)
    kept = paragraphs._occurrences(docs, asked).collect()
    assert {r.doc_id for r in kept} == {20, 21} and all(r.at + r.n > 60 for r in kept)


def test_stretches_of_one_place():
    """Places that touch or overlap and stand in the same way are one stretch."""
    place = pa.struct([("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("lead", place), ("near", place)]))
    at = lambda begin, n, to, near=None: {"at": begin, "n": n, "lead": to, "near": near}
    to = lambda doc_id, begin, n: {"doc_id": doc_id, "digest": 5, "at": begin, "n": n}
    rows = [at(10, 24, to(1, 0, 24)), at(34, 24, to(1, 24, 24), to(None, 3, 24)), at(20, 24, to(1, 10, 24)), at(70, 8, to(1, 60, 9))]
    batch = pa.RecordBatch.from_arrays([pa.array([7, None]), pa.array([8, 9]), pa.array([rows, rows[:1]], kind)], ["doc_id", "digest", "places"])

    class Table:
        def mapInArrow(self, run, kind):
            return [tuple(r.values()) for made in run([batch]) for r in made.to_pylist()]

    want = [(7, 8, 10, 58, 1, 5, 0, 48), (7, 8, 34, 58, None, 5, 3, 27), (7, 8, 70, 78, 1, 5, 60, 69), (None, 9, 10, 34, 1, 5, 0, 24)]
    assert sorted(paragraphs._stretches(Table()), key=str) == sorted(want, key=str)


def test_tables_made_meanwhile_are_deleted(spark):
    rng = random.Random(26)
    base = line(rng, 80)
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = paragraphs.repeated_passages(frame(spark, [base, edited(base, 40), base + " more", line(rng, 50)]))
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert not left & {"met", "occurrences", "sure", "paragraphs", "candidates", "shared", "blocks"}
    assert [bool(r.spans) for r in sorted(found.collect())] == [False, True, True, False]
    assert found.count() == 4
