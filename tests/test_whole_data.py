"""Rules that once stopped at a size: each is tested beyond the old limit, against a plain version."""

import random

from pyspark.sql import functions as F

from cueloom.functions import parsing
from cueloom.operators import consensus, dictionary, intervals, ordered, segments


def test_short_cores_of_a_long_owner(spark):
    owners = spark.createDataFrame([(1, 0, 200_000), (2, -5_000, 4_000)], "o long, a long, b long")
    gaps = spark.createDataFrame([(1, x) for x in range(3_000, 200_000, 7_700)], "o long, x long")
    rows = segments.short_cores(owners, gaps, "o", "a", "b", "x").orderBy("o", "core_no").collect()
    for owner, low, high in ((1, 0, 200_000), (2, -5_000, 4_000)):
        own = [(r.core_start, r.core_end) for r in rows if r.o == owner]
        assert own[0][0] == low and own[-1][1] == high
        assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert all(2_000 <= b - a <= 8_000 for a, b in own)
    assert len([r for r in rows if r.o == 1]) > 25


def test_utterance_suffix_before_many_terminators(spark):
    rows = [(1, 0, "意味"), (1, 1, "！" * 30), (1, 2, "次。"), (1, 3, "意味！"), (1, 4, "！！"), (1, 5, "終。"), (1, 6, "外。")]
    tokens = ordered.dense_blocks(spark.createDataFrame(rows, "k long, tok long, text string"), "tok")
    got = [r.utterance for r in segments.utterances(tokens, ["k"], ["tok"]).orderBy("tok").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 3]


def test_pause_cuts_have_no_limit(spark):
    rows = [(1, k, 5, 1000, 3000, 0) for k in range(40)]
    pieces = ordered.dense_blocks(
        spark.createDataFrame(rows, "k long, at long, lex long, rest_lex long, gap_ms long, speech_ms long"), "at"
    )
    assert segments.pause_cuts(pieces, ["k"], ["at"]).count() == 40
    assert segments.pause_cuts(pieces, ["k"], ["at"], most=11).count() == 11


def test_long_line_numbers_are_foreign(spark):
    rows = [(1, "[1] a\n[2] b", 2), (2, "[1] a\n[12345678901] b", 2), (3, "[1] a\n[123456789012345678901234567890] b", 2)]
    answers = spark.createDataFrame(rows, "id long, answer string, expected long")
    got = parsing.parse_answers(answers, ["id"], "answer", "expected").collect()
    assert {(r.id, r.number) for r in got} == {(1, 1), (1, 2)}
    notes = spark.createDataFrame([(1, "3: x\n[99999999999999999999999] y", 5)], "id long, answer string, n long")
    assert [(r.line, r.in_range) for r in parsing.comments(notes, ["id"], "answer", "n").orderBy("at").collect()] == [(3, True), (None, False)]


def test_json_constants_stand_outside_strings(spark):
    rows = [('{"a": "x, NaN"}',), ('{"a": NaN}',), ('{"a": "\\"", "b": -Infinity}',), ('{"a": {"b": 1, "b": 2}}',)]
    got = spark.createDataFrame(rows, "t string").select(parsing.json_rejection(F.col("t")).alias("r"))
    assert [r.r for r in got.collect()] == [None, "constant", "constant", "malformed"]


def test_overlap_join_below_zero(spark):
    rng = random.Random(4)
    spans = lambda n: [(k, a, a + rng.randint(0, 900)) for k in range(n) for a in [rng.randint(-3000, 3000)]]
    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "l long, ls long, le long").selectExpr("1 AS k", "*")
    b = spark.createDataFrame(right, "r long, rs long, re long").selectExpr("1 AS k", "*")
    got = intervals.overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re"), 250).select("l", "r").collect()
    want = {(x, y) for x, xs, xe in left for y, ys, ye in right if xs < ye and ys < xe and xs < xe and ys < ye}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    empty = spark.createDataFrame([(1, 120_000, 120_000)], "k long, a long, b long")
    assert intervals.spread(empty, "a", "b", 120_000).count() == 0


def test_names_of_any_length(spark):
    texts = spark.createDataFrame([(1, "the big red old house by the big red sea")], "id long, text string")
    names = spark.createDataFrame([("big red old house",), ("big red",), ("sea",)], "surface string")
    got = {(r.at, r.surface) for r in dictionary.occurrences(texts, ["id"], "text", names).collect()}
    assert got == {(2, "big red old house"), (8, "big red"), (10, "sea")}


def test_equal_short_texts_are_equal(spark):
    rows = [(1, k, "え") for k in (1, 2, 3)] + [(2, 4, "え"), (2, 5, "お"), (3, 6, ""), (3, 7, "")]
    table = spark.createDataFrame(rows, "w long, id long, text string")
    got = {r.w: (r.chosen, r.score) for r in consensus.choose_reading(table, ["w"], "id").collect()}
    assert got == {1: (1, 1_000_000), 2: (4, 0), 3: (6, 0)}
    chosen = table.withColumn("c", F.when(F.col("w") == 1, 1).when(F.col("w") == 2, 4).otherwise(6).cast("long"))
    grades = {r.w: (r.supporters, r.grade) for r in consensus.support_grade(chosen, ["w"], "id", "c").collect()}
    assert grades == {1: (3, "A"), 2: (1, "C"), 3: (0, "C")}
