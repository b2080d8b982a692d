"""Folds over keys of many blocks: composed by doubling, whatever the rule remembers."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import ordered, segments


def rounds(monkeypatch):
    seen = []
    real = ordered.pin
    monkeypatch.setattr(ordered, "pin", lambda df, tag="table": (seen.append(tag), real(df, tag))[1])
    return seen


def test_rounds_grow_with_the_logarithm_of_the_blocks(spark, monkeypatch):
    """640 rows in 64 blocks without a gap: three residues that never fall in step."""
    seen = rounds(monkeypatch)
    rows = [(1, k, 1000 * k, 1000 * k + 900, "abcd") for k in range(640)]
    df = spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, text string")
    cut = ordered.dense_blocks(df, "no", 10)
    got = {r.no: r.scene for r in segments.scenes_with_caps(cut, ["k"], ["no"], 3, 10**6).collect()}
    assert got == {k: k // 3 + 1 for k in range(640)}
    assert seen.count("reached") == 6 and seen.count("exits") == 1


@pytest.mark.parametrize("width", [3, 1000])
def test_scenes_with_caps_at_any_width(spark, width):
    rng = random.Random(width)
    rows, want = [], {}
    for key in range(4):
        at, scene, held, chars, last = 0, 0, 0, 0, None
        for no in range(150):
            start = at + rng.choice([0, 100, 3500] if key else [0])
            end, text = start + rng.randint(1, 900), "x" * rng.randint(0, 12)
            rows.append((key, no, start, end, text))
            if last is None or held >= 7 or chars + len(text) > 40 or start - last >= 3000:
                scene, held, chars = scene + 1, 0, 0
            held, chars, last, at = held + 1, chars + len(text), end, end
            want[key, no] = scene
    df = spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, text string")
    got = segments.scenes_with_caps(ordered.dense_blocks(df, "no", width), ["k"], ["no"], 7, 40)
    assert {(r.k, r.no): r.scene for r in got.collect()} == want


def test_group_longer_than_blocks(spark, monkeypatch):
    """A group over many blocks hands its state on through each of them."""
    seen = rounds(monkeypatch)
    rows = [(1, k, 10 * k, 10 * k + 5, "" if k % 40 else "12345678") for k in range(120)]
    df = spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, text string")
    got = segments.scenes_with_caps(ordered.dense_blocks(df, "no", 10), ["k"], ["no"], 10**6, 12)
    assert {r.no: r.scene for r in got.collect()} == {k: k // 40 + 1 for k in range(120)}
    assert seen.count("reached") == 4


@pytest.mark.parametrize("parts", [1, 5])
def test_greedy_windows_over_range_blocks(spark, parts):
    rng = random.Random(1)
    marks, want = [], set()
    for key in range(3):
        centres = sorted(rng.sample(range(1, 60_000), 300 if key else 12))
        marks += [(key, 0, 0), *((key, c, 1) for c in centres), (key, 60_000, 2)]
        base = 0
        while 60_000 - base > 700:
            fits = [c for c in centres if base + int(700 * 0.65) <= c <= base + 700]
            want.add((key, base, cut := max(fits, default=base + 700)))
            base = cut
        want.add((key, base, 60_000))
    df = spark.createDataFrame(marks, "k long, at long, kind int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = segments.greedy_windows(df, ["k"], "at", "kind", 700, 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.k, r.core_start, r.core_end) for r in got} == want


@pytest.mark.parametrize("width", [7, 10_000])
def test_energy_cuts_at_any_width(spark, monkeypatch, width):
    monkeypatch.setattr(ordered, "WIDTH", width)
    real = ordered.dense_blocks
    monkeypatch.setattr(ordered, "dense_blocks", lambda df, at, wide=None: real(df, at, wide or width))
    rng = random.Random(2)
    rows = [(k, f, rng.randint(0, 50), n) for k, n in ((1, 900), (2, 130), (3, 90)) for f in range(n)]
    df = spark.createDataFrame(rows, "k long, frame long, power long, total long")
    got = sorted(map(tuple, segments.energy_cuts(df, ["k"], "frame", "power", "total", 4).collect()))
    power = {(k, f): p for k, f, p, _ in rows}
    want = []
    for key, whole in ((1, 900), (2, 130), (3, 90)):
        base = 0
        while whole - base > 120:
            rest = whole - base
            low, high, aim = (max(60, rest - 100), min(100, rest - 60), rest // 2) if rest <= 160 else (72, 100, 88)
            cut = base + min(range(low, high + 1), key=lambda off: (power[key, base + off], abs(off - aim), off))
            want.append((key, base, cut))
            base = cut
        want += [(key, base, (base + whole) // 2), (key, (base + whole) // 2, whole)] if whole - base > 100 else [(key, base, whole)]
    assert got == sorted(want)


def test_media_end_and_failure(spark):
    """Reading time ends with the medium; a cue beyond it cannot be placed."""
    from cueloom.operators import timing

    rows = [(1, 1, 0, 1000, "a" * 18, 1500), (2, 1, 0, 1000, "a" * 18, None), (3, 1, 0, 900, "a" * 18, 900), (3, 2, 1300, 900, "b", 900)]
    df = spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, text string, media long")
    ranked = df.withColumns({"o1": F.col("start_ms"), "o2": F.col("end_ms")})
    done = timing.finalize(ordered.range_blocks(ranked, ["k"], ["o1", "o2", "no"]), ["k"], ["o1", "o2", "no"], "media")
    got = {(r.k, r.no): (r.start_ms, r.end_ms, r.below_minimum, r.placed) for r in done.collect()}
    assert got[1, 1] == (0, 1500, True, True)
    assert got[2, 1] == (0, 2300, False, True)
    assert got[3, 1][3] and not got[3, 2][3]


@pytest.mark.parametrize("width", [5, 10_000])
def test_issue_states(spark, monkeypatch, width):
    from cueloom.operators import ledger

    rng = random.Random(4)
    kinds = ["issue", "persists", "resolved", "unsupported", "repair", "seen"]
    rows = [(i % 3, i, rng.choice(kinds)) for i in range(120)]
    seen = rounds(monkeypatch)
    log = ordered.dense_blocks(spark.createDataFrame(rows, "k long, no long, ev string"), "no", width)
    got = {(r.k, r.no): (r.state, r.attempts, r.changed) for r in ledger.issue_states(log, ["k"], ["no"], "ev").collect()}
    held, want = {}, {}
    for k, no, ev in rows:
        state, n = held.get(k, ("not_flagged", 0))
        after = ledger.LIFECYCLE.get((state, ev), state)
        after = state if ev == "repair" and n >= 2 else after
        n += after == "repaired" and state != "repaired"
        held[k], want[k, no] = (after, n), (after, n, int(after != state))
    assert got == want
    assert seen.count("exits") == (1 if width == 5 else 0)
