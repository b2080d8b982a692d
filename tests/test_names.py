"""Names in texts with and without spaces."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.operators import dictionary, ledger


def found(spark, rows, names):
    docs = spark.createDataFrame(rows, "k long, t string")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "surface string, entity long")
    return {(r.k, r.start, r.end, r.surface, r.entity) for r in dictionary.occurrences(docs, ["k"], "t", table).collect()}


@pytest.mark.parametrize("block", [4_000_000, 20])
def test_unspaced_scripts(spark, monkeypatch, block):
    monkeypatch.setattr(dictionary, "BLOCK_CHARS", block)
    names = ["ソラ", "ソラノ", "夏雪", "夏雪町", "みな", "lin", "lin yu"]
    rows = [
        (1, "ソラは夏雪町でソラノに手を振る"), (2, "昨天夏雪唱了很久"), (3, "みなはみな 歩く"), (4, "Lin Yu met lin, not linen"), (5, None), (6, ""),
    ]
    got = found(spark, rows, names)
    assert got == {
        (1, 0, 2, "ソラ", 0), (1, 3, 6, "夏雪町", 3), (1, 7, 10, "ソラノ", 1), (2, 2, 4, "夏雪", 2), (4, 0, 6, "lin yu", 6), (4, 11, 14, "lin", 5),
    }


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_places_against_every_substring(spark, monkeypatch, block):
    """Ideographs have an edge at every character, so any substring may be a name."""
    monkeypatch.setattr(dictionary, "BLOCK_CHARS", block)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("山川田") for _ in range(n))
    names = sorted({text(rng.randint(1, 6)) for _ in range(60)})
    rows = [(k, text(rng.randint(0, 120))) for k in range(30)]
    want = set()
    for k, t in rows:
        spans = [(a, b) for a in range(len(t)) for b in range(a + 1, len(t) + 1) if t[a:b] in names]
        want |= {
            (k, a, b, t[a:b], names.index(t[a:b])) for a, b in spans if not any(c <= a and b <= d and d - c > b - a for c, d in spans)
        }
    assert found(spark, rows, names) == want


def test_contexts(spark):
    names = spark.createDataFrame([("ana",), ("bo",)], "surface string")
    docs = spark.createDataFrame([(1, "then ana ran. then bo ran. so ana sat"), (2, "ana sat")], "k long, t string")
    got = {(r.k, r["at"], r.left, r.right, r.alone) for r in dictionary.occurrences(docs, ["k"], "t", names).collect()}
    assert got == {(1, 2, "then", "ran", False), (1, 5, "then", "ran", False), (1, 8, "so", "sat", True), (2, 1, None, "sat", False)}


def test_masks_without_spaces(spark):
    docs = spark.createDataFrame([(1, "ソラは夏雪とソラノ夏雪"), (2, "雪夏雪町"), (3, None), (4, "⟦E0001⟧ソラ")], "k long, t string")
    names = spark.createDataFrame([("ソラ", 1), ("夏雪", 2), ("雪町", 3)], "surface string, entity long")
    cut = {r.k: r.cut for r in dictionary.marked(docs, "t", names, ["k"]).collect()}
    assert cut[1].marked == "⟦E0000⟧は⟦E0002⟧とソラノ⟦E0006⟧"
    assert cut[1].surfaces == ["ソラ", "夏雪", "夏雪"]
    assert cut[2].marked == "雪夏雪町"  # two names overlap
    assert cut[3].marked is None
    back = dictionary.restored()(F.col("cut.marked"), F.col("cut.markers"), F.col("cut.surfaces"))
    rows = dictionary.marked(docs, "t", names, ["k"]).withColumn("b", back).collect()
    assert [(r.k, r.b.restored, r.b.exact) for r in sorted(rows) if r.t is not None] == [
        (1, docs.filter("k = 1").first().t, True), (2, "雪夏雪町", True), (4, "⟦E0001⟧ソラ", False),
    ]
    marked, values = ledger.mask_names(docs, "k", "t", names)
    assert {r.k: r.exact for r in ledger.restore_names(marked, values, "k", "marked").collect()} == {1: True, 2: True, 3: None, 4: False}


def test_lower_case_keeps_places():
    assert len(dictionary.lowered("İstanbul ΣΑΣ")) == len("İstanbul ΣΑΣ")
    assert re.fullmatch(r".stanbul .*", dictionary.lowered("İstanbul ΣΑΣ"))


def test_names_are_compared_where_they_may_begin():
    """A text of ideographs has an edge at every character; that alone makes no comparison."""

    class Asked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    known = dictionary.Lexicon(["山川田山川田山川田", "山川田川田川田川田"])
    known.number = Asked(known.number)
    found = known.places("山" * 5000 + "山川田山川田山川田" + "川" * 5000)
    assert [(p[3], p[4], p[-1]) for p in found] == [(5000, 5009, 0)]
    assert known.number.n < 50


def test_atoms_by_kind():
    rng = random.Random(9)
    kinds, _ = dictionary._characters()
    for _ in range(300):
        text = "".join(rng.choice("ソラーみな山〇〡ab1２Ⅳ .・㋐⺀々\n𠀀𝐀") for _ in range(rng.randint(0, 30)))
        want = [m.start() for m in dictionary.ATOM.finditer(text)]
        assert dictionary._atom_starts(text, kinds[dictionary._codes(text)]).tolist() == want
        plain = text.replace("〇", "").replace("〡", "")
        assert np.array_equal(dictionary._atom_starts(plain, kinds[dictionary._codes(plain)]), [m.start() for m in dictionary.ATOM.finditer(plain)])
