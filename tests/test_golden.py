"""Literal expectations and brute-force twins for operators without SQL."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cueloom.functions import parsing, text as tx, timecode as tc
from cueloom.operators import align, consensus, dictionary, layout, ledger, ordered, segments, timing
from cueloom.sources import files


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(expr(*[F.col(n) for n in names]).alias("x")).first().x


def test_convention_and_preservation(spark):
    assert one(spark, tx.convention, "阿岚，灯塔今晚亮着。") == "阿岚 灯塔今晚亮着"
    assert one(spark, tx.convention, "几点了？快、快走吧…") == "几点了？快、快走吧…"
    assert one(spark, tx.convention, "风停了。…") == "风停了…"
    assert one(spark, tx.convention, "船还没到港…。…") == "船还没到港……"
    assert one(spark, tx.preserved, "晴天，出海。", "晴天 出海") is True
    assert one(spark, tx.preserved, "晴天，出海。", "晴天 出") is False


def test_sentences(spark):
    assert one(spark, tx.sentences, "下雪了，阿岚。…关窗吧。") == ["下雪了，阿岚。", "…关窗吧。"]
    assert one(spark, tx.sentences, "みぞれ。ゆき?はれ") == ["みぞれ。", "ゆき?", "はれ"]
    assert one(spark, tx.sentences, "「わかった。」…") == ["「わかった。」…"]
    assert one(spark, tx.script_sentences, "（港）\nソラ：波が高い。帰る？\n\n【汽笛】\nまだ") == ["波が高い。", "帰る？", "まだ"]


def test_scalar_rules(spark):
    assert one(spark, tx.suspicious, "どんどんどんどん") is True
    assert one(spark, tx.suspicious, "どんどんどん") is False
    assert one(spark, tx.compact, "Ｑｒ，ー７!") == "qrー7"
    assert one(spark, tx.kana_reading, "ちゃー、っぷ！") == "ちやつぷ"
    assert one(spark, tx.clean_title, "01.【PV】　霧の港") == "霧の港"
    assert one(spark, tx.clean_title, "track 07 - [x] 灯") == "灯"
    assert [one(spark, tx.meaningful_title, v) for v in ("霧の港", "track", "12", "LAMP", "main")] == [True, False, False, True, False]
    assert one(spark, tx.occurrences, "aaaa", "aa") == 3
    assert one(spark, tx.fix_rejection, "无需修改", "前", "海面上的雾很浓") == "meta"
    assert one(spark, tx.fix_rejection, "哦", "前", "な" * 30) == "too_short"
    assert one(spark, tx.fix_rejection, "哦", "前", "なに") is None
    assert one(spark, tx.anchored, "朝その船が出た", "その船", "あの船", "ほら朝あの船が出たね") is True
    assert one(spark, tx.anchored, "朝その船が出た", "その船", "あの船", "あの船") is False
    text = "ab" * 400
    assert one(spark, tx.compression_ratio, text) == pytest.approx(800 / len(zlib.compress(text.encode())))
    assert one(spark, tc.parse_ms, "01:02:03,004") == 3723004
    assert one(spark, tc.parse_ms, "01:62:03,004") is None


def test_restore_parts(spark):
    df = spark.createDataFrame([(1, "One, two. Three! … Four")], "k long, t string")
    got = [r.part for r in layout.restore_parts(df, ["k"], "t").orderBy("part_no").collect()]
    assert "".join(got) == "One, two. Three! … Four" and len(got) == 3


def test_comments(spark):
    answer = "- 3: p\n[4] q\n第5行: r\n无\n行号: 6：s\n99: t\nloose"
    df = spark.createDataFrame([(1, answer, 10)], "k long, a string, n int")
    got = [(r.line, r.note, r.in_range) for r in parsing.comments(df, ["k"], "a", "n").orderBy("at").collect()]
    assert got == [(3, "p", True), (4, "q", True), (5, "r", True), (6, "s", True), (99, "t", False)]


def test_positional_answers(spark):
    df = spark.createDataFrame([(1, "x\n\ny", 3), (2, "[2] b\n[2] c", 2)], "k long, a string, n long")
    got = {(r.k, r.number): (r.value, r.missing) for r in parsing.last_answers(df, ["k"], "a", "n").collect()}
    assert got == {(1, 1): ("x", False), (1, 2): ("y", False), (1, 3): ("", True), (2, 1): ("", True), (2, 2): ("c", False)}


def test_utterance_keeps_negation(spark):
    words = [("そこ", 1), ("触ん", 2), ("な。", 3), ("届くことが", 4), ("。", 5), ("ない。", 6), ("朝", 7)]
    df = spark.createDataFrame([(1, n, w) for w, n in words], "k long, no long, text string")
    for width in (2, 100):
        got = segments.utterances(ordered.dense_blocks(df, "no", width), ["k"], ["no"]).orderBy("no").collect()
        assert [r.utterance for r in got] == [1, 1, 1, 2, 2, 2, 3]


def test_sentence_units_and_repair(spark):
    rows = [(1, 1, "霧だね。", 0, 500), (1, 2, "ただ", 600, 800), (1, 3, "灯台だけ", 2000, 2500), (1, 4, "見える", 2600, 3000)]
    df = spark.createDataFrame(rows, "k long, no long, text string, start_ms long, end_ms long")
    got = [r.text for r in layout.sentence_units(df, ["k"], "no").orderBy("unit_no").collect()]
    assert got == ["霧だね。", "ただ灯台だけ見える"]
    schema = "k long, no long, text string, start_ms long, end_ms long, lo long, hi long"
    for third, span in ((2600, (2000, 2600)), (6000, (2000, 2900))):
        rows = [(1, 1, "夜明けの港は静かなのね", 0, 2000, 0, 8000), (1, 2, "船を待ちたい", 2400, 2500, 0, 8000), (1, 3, "まだ", third, third + 300, 0, 8000)]
        fixed = timing.repair(spark.createDataFrame(rows, schema), ["k"], "no", "text", ("lo", "hi")).orderBy("no").collect()
        assert (fixed[1].start_ms, fixed[1].end_ms, fixed[1].repaired) == (*span, True)
    rows = [(1, 1, "なみのおとがきこえる", 0, 100, 0, 5000), (1, 2, "ね", 200, 500, 0, 5000)]
    assert timing.repair(spark.createDataFrame(rows, schema), ["k"], "no", "text", ("lo", "hi")).first().failed


def test_split_and_place(spark):
    text = "早上下了一场雨，我们沿着河边慢慢走回家。你还记得那座旧桥吗？桥头的面包店每天六点开门，整条街都闻得到香味。"
    long = spark.createDataFrame([(1, text, 0, 10000), (2, "", 0, 5), (3, "没有标点的一行", 3, 9)], "k long, said string, lo long, hi long")
    parts = layout.split_pieces(long, ["k"], "said", "lo", "hi").orderBy("k", "start_ms").collect()
    own = [p for p in parts if p.k == 1]
    assert "".join(p.text for p in own) == text and len(own) > 2
    assert all(len(p.text) <= 21 for p in own)
    assert own[0].start_ms == 0 and own[-1].end_ms == 10000
    assert all(a.end_ms == b.start_ms for a, b in zip(own, own[1:]))
    assert [(p.text, p.start_ms, p.end_ms) for p in parts if p.k != 1] == [("没有标点的一行", 3, 9)]
    two = spark.createDataFrame([(1, "门开了。外面的雪还在下。", [0, 9000], [1000, 11000])], "k long, said string, lo array<long>, hi array<long>")
    placed = layout.place_pieces(two, ["k"], "said", "lo", "hi").orderBy("start_ms").collect()
    assert [p.text for p in placed] == ["门开了。", "外面的雪还在下。"]
    assert placed[0].end_ms <= 1000 and placed[1].start_ms >= 9000
    one_unit = spark.createDataFrame([(1, "门开了。外面的雪还在下。", [0], [1000])], "k long, said string, lo array<long>, hi array<long>")
    assert [p.text for p in layout.place_pieces(one_unit, ["k"], "said", "lo", "hi").collect()] == ["门开了。外面的雪还在下。"]


def test_share_partition(spark):
    def run(units, pieces):
        a = spark.createDataFrame([(1, i, u) for i, u in enumerate(units, 1)], "k long, unit_no long, text string")
        b = spark.createDataFrame([(1, i, u) for i, u in enumerate(pieces, 1)], "k long, piece_no long, text string")
        rows = layout.share_partition(a, b, ["k"]).orderBy("group_no").collect()
        return [(r.first_unit, r.last_unit, r.first_piece, r.last_piece) for r in rows]

    assert run(["みなとまち。", "ふね。", "あさがくるよ。"], ["港边小镇上。", "船呢。", "清晨就要来了。"]) == [(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)]
    assert run(["な。", "に。", "ぬ。"], ["同一句。"]) == [(1, 3, 1, 1)]


def test_short_cores(spark):
    owners = spark.createDataFrame([(1, 0, 20000), (2, 20000, 29000)], "o long, s long, e long")
    gaps = spark.createDataFrame([(1, 6000), (1, 3000), (1, 13100)], "o long, x long")
    got = [(r.o, r.core_start, r.core_end) for r in segments.short_cores(owners, gaps, "o", "s", "e", "x").orderBy("o", "core_no").collect()]
    assert got == [(1, 0, 6000), (1, 6000, 13100), (1, 13100, 20000), (2, 20000, 26000), (2, 26000, 29000)]


def test_pause_cuts(spark):
    rows = [(1, 1, 3, 3, 3000, 0), (1, 2, 1, 2, 3000, 0), (2, 1, 5, 4, 3000, 3000), (3, 1, 5, 4, 3000, 600)]
    df = spark.createDataFrame(rows, "k long, no long, lex long, rest_lex long, gap_ms long, speech_ms long")
    got = [(r.k, r.no) for r in segments.pause_cuts(ordered.dense_blocks(df, "no"), ["k"], ["no"]).collect()]
    assert sorted(got) == [(1, 1), (3, 1)]


def test_ordered_edits_and_masks(spark):
    edit = "array<struct<old:string,new:string>>"
    df = spark.createDataFrame([("a b a c", [("b", "a"), ("a", "z"), ("c", "")])], f"t string, e {edit}")
    r = df.select(ledger.apply_in_order(F.col("t"), F.col("e")).alias("r")).first().r
    assert (r.text, r.applied, r.refused) == ("a a a ", 2, 1)
    docs = spark.createDataFrame([(1, "Anna met anna, Bob."), (2, "none")], "k long, t string")
    names = spark.createDataFrame([("anna", 7)], "surface string, entity long")
    marked, values = ledger.mask_names(docs, "k", "t", names)
    assert {r.k: r.marked for r in marked.collect()} == {1: "⟦E0000⟧ met ⟦E0004⟧, Bob.", 2: "none"}
    back = {r.k: (r.restored, r.exact) for r in ledger.restore_names(marked, values, "k", "marked").collect()}
    assert back == {1: ("Anna met anna, Bob.", True), 2: ("none", True)}
    lost = marked.withColumn("marked", F.replace("marked", F.lit("⟦E0004⟧"), F.lit("⟦E0000⟧")))
    assert not {r.k: r.exact for r in ledger.restore_names(lost, values, "k", "marked").collect()}[1]


def dice(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    return 2_000_000 * sum((x & y).values()) // max(1, sum(x.values()) + sum(y.values())) if x and y else 0


def test_dice_join_finds_every_pair(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(2, 14))) for _ in range(120)})
    left = spark.createDataFrame([(f"l{i}", t) for i, t in enumerate(texts)], "l string, t string")
    right = spark.createDataFrame([(f"r{i}", t[::-1] + "a") for i, t in enumerate(texts)], "r string, t string")
    got = {(r.l, r.r, r.dice) for r in align.dice_join(left, right, "l", "r", "t").collect()}
    want = {(f"l{i}", f"r{j}", dice(a, b[::-1] + "a")) for i, a in enumerate(texts) for j, b in enumerate(texts)}
    assert got == {w for w in want if w[2] >= 600_000}


@pytest.mark.parametrize("width", [1, 256])
def test_monotone_anchors(spark, width, monkeypatch):
    rng = random.Random(4)
    rows = [(1, line, rng.randrange(1, 300), rng.randrange(1, 5), rng.randrange(600_000, 1_000_000)) for line in range(1, 60) for _ in range(rng.randrange(0, 9))]
    rows = list({r[:4]: r for r in rows}.values())
    cut = ordered.dense_blocks
    monkeypatch.setattr(align.ordered, "dense_blocks", lambda df, c, w: cut(df, c, width))
    df = spark.createDataFrame(rows, "k long, line long, idx long, span int, dice long")
    got = sorted((r.line, r.idx, r.span, r.dice) for r in align.monotone_anchors(df, ["k"], "line").collect())
    prev, want = None, []
    for line in range(1, 60):
        near = [r for r in sorted(rows) if r[1] == line and (prev is None or max(1, prev - 5) <= r[2] < prev + 80)]
        if near:
            best = max(near, key=lambda r: (r[4], -r[2], -r[3]))
            want.append(best[1:])
            prev = best[2] + best[3] - 1
    assert got == want


def test_consensus(spark):
    rows = [(1, 1, "a gull rests on the quay"), (1, 2, "a gull rests on one quay"), (1, 3, "zzzz qqqq"), (2, 4, "alone"),
            (3, 5, "short tail end"), (3, 6, "short tail end"), (3, 7, "a much longer opening speech and then the short tail end")]
    df = spark.createDataFrame(rows, "w long, id long, text string")
    got = {r.w: r for r in consensus.choose_reading(df, ["w"], "id").collect()}
    assert got[1].chosen in (1, 2) and got[1].n_readings == 3
    assert (got[2].chosen, got[2].score) == (4, 0)
    assert (got[3].chosen, got[3].longer_kept) == (7, True) and got[3].score <= 600_000
    same = spark.createDataFrame([(1, i, "七つのランプ", 1) for i in (1, 2, 3)] + [(2, 1, "漁港の朝です", 1), (2, 2, "霧", 1)], "w long, id long, text string, c long")
    graded = {r.w: r.grade for r in consensus.support_grade(same, ["w"], "id", "c").collect()}
    assert graded == {1: "A", 2: "C"}


def test_longest_names(spark):
    docs = spark.createDataFrame([(1, "new york city is new")], "k long, t string")
    names = spark.createDataFrame([("new",), ("new york",), ("city",)], "surface string")
    got = sorted((r["at"], r.surface) for r in dictionary.occurrences(docs, ["k"], "t", names).collect())
    assert got == [(1, "new york"), (3, "city"), (5, "new")]


def test_encodings_and_json(spark):
    rows = [("u", "héllo".encode()), ("s", "こんにちは".encode("cp932")), ("b", b"\xef\xbb\xbfx"), ("m", ("�" * 5 + "a").encode())]
    got = {r.k: (r.d.text, r.d.encoding) for r in spark.createDataFrame(rows, "k string, c binary").select("k", files.decode_fallback("c").alias("d")).collect()}
    assert got["u"] == ("héllo", "utf-8-sig") and got["s"] == ("こんにちは", "cp932") and got["b"] == ("x", "utf-8-sig")
    assert got["m"][1] != "utf-8-sig"
    bad = {'{"a":1,"a":2}': "duplicate_key", '{"a":NaN}': "constant", "[1]": "not_object", '{"a"': "malformed", '{"a":1}': None}
    for value, want in bad.items():
        assert one(spark, parsing.json_rejection, value) == want


def test_srt_files(spark, tmp_path):
    body = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n one \r\ntwo\r\n\r\nx\r\nbad\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\nthree\r\n"
    (tmp_path / "a.srt").write_bytes(body.encode())
    chunks = files.read_srt_chunks(spark, str(tmp_path))
    got = [(r.cue_id, r.ts_line, r.text) for r in files.parse_srt(chunks, ["path"]).orderBy("cue_id").collect()]
    assert got == [(1, "00:00:01,000 --> 00:00:02,000", "one\ntwo"), (3, "00:00:03,000 --> 00:00:04,000", "three")]
    reasons = sorted(str(r.reject_reason) for r in files.srt_rejections(chunks, ["path"]).collect())
    assert reasons == ["None", "None", "under_three_lines"]
    with pytest.raises(Exception, match="Malformed SRT chunk"):
        files.require_clean(files.srt_rejections(chunks, ["path"])).collect()
    found = files.media_catalogue(spark, str(tmp_path), ["srt"]).collect()
    assert len(found) == 1
