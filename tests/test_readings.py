"""Dictionary readings against every division of short texts."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import readings

TABLE = [("山川", "さんせん", 3000), ("山", "やま", 4000), ("川", "かわ", 4000), ("川田", "かわた", 4500), ("はし", "はし", 2000), ("橋", "はし", 3000),
         ("箸", "はし", 3000), ("ann", "あん", 1000), ("一", "イチ", 5000), ("一", "ひと", 5000), ("", "x", 1), ("火", None, 1), ("水", "みず", -1)]


def read(spark, rows, table=TABLE):
    docs = spark.createDataFrame(rows, "k long, t string")
    words = spark.createDataFrame(table, "surface string, reading string, cost long")
    return {r.k: r.words for r in readings.read_words(docs, "t", words, ["k"]).collect()}


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_words(spark, monkeypatch, block):
    monkeypatch.setattr(readings, "BLOCK_CHARS", block)
    rows = [(1, "山川田"), (2, "Anna Ann橋"), (3, ""), (4, None), (5, "一火水"), (6, "そらはし。12")]
    got = read(spark, rows)
    show = {k: None if v is None else [(w.surface, w.reading, w.known) for w in v] for k, v in got.items()}
    assert show == {
        1: [("山", "やま", True), ("川田", "かわた", True)],
        2: [("Anna", "anna", False), (" ", " ", False), ("Ann", "あん", True), ("橋", "はし", True)],
        3: [], 4: None,
        5: [("一", "ひと", True), ("火", "火", False), ("水", "水", False)],
        6: [("そら", "そら", False), ("はし", "はし", True), ("。", "。", False), ("12", "12", False)],
    }
    assert [w.start for w in got[2]] == [0, 4, 5, 8]


def test_empty_tables(spark):
    assert [(w.surface, w.known) for w in read(spark, [(1, "山川 abc")], [])[1]] == [("山", False), ("川", False), (" ", False), ("abc", False)]
    assert read(spark, []) == {}


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_cheapest_of_all_divisions(spark, monkeypatch, block):
    monkeypatch.setattr(readings, "BLOCK_CHARS", block)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("山川田") for _ in range(n))
    table = {text(rng.randint(1, 4)): (f"r{i}", rng.choice([3000, 9000, 11000, 20000])) for i in range(25)}
    rows = [(k, text(rng.randint(0, 11))) for k in range(40)]

    def divisions(t):
        if not t:
            yield []
        for n in range(1, len(t) + 1):
            if t[:n] in table or n == 1:
                for rest in divisions(t[n:]):
                    if t[:n] in table:
                        yield [(table[t[:n]][1], 0, -n, table[t[:n]][0]), *rest]
                    if n == 1:
                        yield [(readings.UNKNOWN, 1, -1, t[0]), *rest]

    got = read(spark, rows, [(s, r, c) for s, (r, c) in table.items()])
    for k, t in rows:
        best = min(divisions(t), key=lambda way: (sum(w[0] for w in way), [w[1:3] for w in way]))
        assert [w.reading for w in got[k]] == [w[3] for w in best], t


def test_notes_and_conflicts(spark):
    table = spark.createDataFrame(TABLE, "surface string, reading string, cost long")
    lines = spark.createDataFrame([(1, 1, "川の箸は"), (1, 2, "橋"), (2, 1, "箸"), (1, 3, None), (1, 4, "")], "work long, no long, t string")
    titles = spark.createDataFrame([(1, "橋と箸と川"), (3, "橋")], "work long, title string")
    read_lines = readings.read_words(lines, "t", table, ["work", "no", "t"])
    notes = readings.homophone_notes(read_lines, readings.read_words(titles, "title", table, ["work"]), "t", "work", ["no"])
    assert {r.no: r.notes for r in notes.collect()} == {1: ["橋(はし)"]}
    rows = spark.createDataFrame([(1, "橋", "はし"), (2, "山橋", "山はし"), (3, "山川", "川山"), (4, "葉し", "橋"), (5, "橋", "箸")], "k long, a string, b string")
    both = readings.read_words(readings.read_words(rows, "a", table, ["k", "a", "b"]).withColumnRenamed("words", "aw"), "b", table, ["k", "a", "b", "aw"])
    got = {r.k: r.x for r in both.select("k", readings.spelling_conflict(F.col("a"), F.col("b"), F.col("aw"), F.col("words")).alias("x")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}
