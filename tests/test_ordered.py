"""Scans, islands and folds must not depend on where blocks are cut."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import intervals, ordered, segments, timing


def cue_rows(n, seed, hot=0.4):
    rng = random.Random(seed)
    out, at = [], {}
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(1, 6)
        no, t = at.get(key, (0, 0))
        start = t + rng.choice([0, 0, 30, 900, 3000, 3500])
        end = start + rng.randrange(150, 4000)
        at[key] = (no + 1, end - rng.choice([0, 0, 0, 200]))
        out.append((key, no + 1, start, end, "x" * rng.randrange(1, 40)))
    return out


@pytest.fixture(scope="module")
def cues(spark):
    rows = cue_rows(400, 7)
    return spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, text string"), rows


def by_key(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [3, 17, 4096])
def test_scan(spark, cues, width):
    df, rows = cues
    got = ordered.scan(
        ordered.dense_blocks(df, "no", width), ["k"], ["no"],
        before={"b": F.col("end_ms") - F.col("start_ms")}, lag={"p": F.col("end_ms")}, lead={"n": F.col("start_ms")},
        peak={"m": F.col("end_ms")}, fill={"f": F.when(F.length("text") > 30, F.col("no"))},
    ).select("k", "no", "b", "p", "n", "m", "f").collect()
    want = set()
    for k, group in by_key(rows).items():
        b, fill = 0, None
        for i, r in enumerate(group):
            fill = r[1] if len(r[4]) > 30 else fill
            want.add((
                k, r[1], b, group[i - 1][3] if i else None, group[i + 1][2] if i + 1 < len(group) else None,
                max(x[3] for x in group[:i]) if i else None, fill,
            ))
            b += r[3] - r[2]
    assert {tuple(r) for r in got} == want


def test_scan_on_range_blocks_without_key(spark, cues):
    df, rows = cues
    cut = ordered.range_blocks(df, [], ["start_ms", "k", "no"])
    assert cut.select(ordered.BLOCK).distinct().count() > 1
    got = {(r.k, r.no): r.b for r in ordered.scan(cut, [], ["start_ms", "k", "no"], before={"b": F.lit(1)}).collect()}
    want = {(r[0], r[1]): i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1])))}
    assert got == want


@pytest.mark.parametrize("width", [2, 11, 4096])
def test_scenes(spark, cues, width):
    df, rows = cues
    got = {(r.k, r.no): r.scene for r in segments.scenes_with_caps(ordered.dense_blocks(df, "no", width), ["k"], ["no"], 4, 90).collect()}
    want = {}
    for k, group in by_key(rows).items():
        scene, n, chars, last = 0, 0, 0, None
        for r in group:
            if last is None or n >= 4 or chars + len(r[4]) > 90 or r[2] - last >= 3000:
                scene, n, chars = scene + 1, 0, 0
            n, chars, last = n + 1, chars + len(r[4]), r[3]
            want[(k, r[1])] = scene
    assert got == want
    gap = {(r.k, r.no): r.scene for r in segments.scenes_by_gap(ordered.dense_blocks(df, "no", width), ["k"], ["no"]).collect()}
    want_gap = {}
    for k, group in by_key(rows).items():
        scene = 0
        for i, r in enumerate(group):
            scene += not i or r[2] - group[i - 1][3] >= 3000
            want_gap[(k, r[1])] = scene
    assert gap == want_gap


def reference_timing(group):
    cues = [dict(no=r[1], s=r[2], e=r[3], need=max(800, len(r[4]) * 1000 // 9)) for r in sorted(group, key=lambda r: (r[2], r[3], r[1]))]
    for a, b in zip(cues, cues[1:]):
        if b["s"] < a["e"] + 40:
            a["e"] = max(a["s"] + 200, b["s"] - 40)
            b["s"] = max(b["s"], a["e"] + 40)
            b["e"] = max(b["e"], b["s"] + 200)
    top = lambda i: cues[i + 1]["s"] - 40 if i + 1 < len(cues) else 10**12
    for i, c in enumerate(cues):
        c["e"] = max(c["e"], min(c["s"] + c["need"], top(i)))
        if c["e"] - c["s"] < c["need"]:
            c["s"] = max(cues[i - 1]["e"] + 40 if i else 0, min(c["s"], c["e"] - c["need"]))
    for i, c in enumerate(cues):
        c["e"] = min(max(c["e"], min(c["e"] + 300, top(i))), c["s"] + max(7000, c["need"]))
    return {c["no"]: (c["s"], c["e"]) for c in cues}


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_final_timing_and_hold(spark, cues, width):
    df, rows = cues
    ranked = df.withColumns({"o1": F.col("start_ms"), "o2": F.col("end_ms")})
    done = timing.finalize(ordered.range_blocks(ranked, ["k"], ["o1", "o2", "no"]), ["k"], ["o1", "o2", "no"])
    got = {(r.k, r.no): (r.start_ms, r.end_ms) for r in done.collect()}
    want = {(k, n): v for k, g in by_key(rows).items() for n, v in reference_timing(g).items()}
    assert got == want
    held = timing.hold(ordered.dense_blocks(df, "no", width), ["k"], ["no"])
    got = {(r.k, r.no): (r.hold_start, r.hold_end) for r in held.collect()}
    want = {}
    for k, g in by_key(rows).items():
        before = 0
        for i, r in enumerate(g):
            nxt = g[i + 1][2] if i + 1 < len(g) else r[3] + 1000
            a = max(before, r[2] - 80)
            b = min(nxt, max(r[3], a + min(6000, max(1000, len(r[4]) * 100))))
            if b - a < 400:
                a = max(before, min(a, b - 800))
            before = b
            want[(k, r[1])] = (a, b)
    assert got == want


@pytest.mark.parametrize("width", [2, 4096])
def test_flash_merge(spark, width):
    rng = random.Random(3)
    rows, t = [], 0
    for no in range(1, 200):
        d = rng.choice([100, 200, 300, 700, 900])
        rows.append((no % 2 and 1 or 1, no, t, t + d, (no // 4)))
        t += d
    df = spark.createDataFrame(rows, "k long, no long, start_ms long, end_ms long, u long")
    got = {r.no: r.display_no for r in timing.merge_flashes(ordered.dense_blocks(df, "no", width), ["k"], ["no"], "u").collect()}
    work, i = [dict(ids=[r[1]], s=r[2], e=r[3], u=r[4]) for r in rows], 0
    while i < len(work):
        r = work[i]
        if r["e"] - r["s"] < 400:
            if i and work[i - 1]["u"] == r["u"]:
                work[i - 1]["ids"] += r["ids"]
                work[i - 1]["e"] = r["e"]
                work.pop(i)
                continue
            if i + 1 < len(work) and work[i + 1]["u"] == r["u"]:
                work[i + 1]["ids"] = r["ids"] + work[i + 1]["ids"]
                work[i + 1]["s"] = r["s"]
                work.pop(i)
                continue
        i += 1
    assert got == {n: i for i, w in enumerate(work, 1) for n in w["ids"]}


def test_energy_cuts(spark):
    rng, unit = random.Random(11), 4
    signals = {k: [rng.randrange(0, 50) for _ in range(n)] for k, n in enumerate([5, 90, 110, 130, 163, 700, 1001])}
    rows = [(k, i, x, len(s)) for k, s in signals.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "k long, frame long, x long, total long")
    power = segments.moving_power(df, ["k"], "frame", "x", 2)
    got = sorted(tuple(r) for r in segments.energy_cuts(power, ["k"], "frame", "power", "total", unit).collect())
    want = []
    for k, s in signals.items():
        n, base = len(s), 0
        level = [sum(v * v for v in s[max(0, i - 2) : i + 2]) * 1000 // len(s[max(0, i - 2) : i + 2]) for i in range(n)]
        while n - base > 30 * unit:
            rest = n - base
            low, high, aim = (18 * unit, 25 * unit, 22 * unit) if rest > 40 * unit else (
                max(15 * unit, rest - 25 * unit), min(25 * unit, rest - 15 * unit), rest // 2)
            cut = min(range(base + low, base + high + 1), key=lambda i: (level[i], abs(i - base - aim), i))
            want.append((k, base, cut))
            base = cut
        if n - base > 25 * unit:
            half = (base + n) // 2
            want += [(k, base, half), (k, half, n)]
        else:
            want.append((k, base, n))
    assert got == sorted(want)


def test_greedy_windows_over_blocks(spark):
    rng = random.Random(5)
    marks = sorted(rng.sample(range(1, 400_000), 60))
    rows = [(1, 0, 0)] + [(1, m, 1) for m in marks] + [(1, 400_001, 2)]
    df = spark.createDataFrame(rows, "k long, at long, kind int")
    got = sorted((r.core_start, r.core_end) for r in segments.greedy_windows(df, ["k"], "at", "kind", 20_000, 800).collect())
    cuts = [0]
    while 400_001 - cuts[-1] > 20_000:
        near = [m for m in marks if cuts[-1] + 13_000 <= m <= cuts[-1] + 20_000]
        cuts.append(max(near) if near else cuts[-1] + 20_000)
    cuts.append(400_001)
    assert got == list(zip(cuts, cuts[1:]))


def test_intervals_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice([0, 0, 1]), i, s, s + rng.randrange(1, 900)) for i, s in enumerate(rng.randrange(0, 5000) for _ in range(n))]
    a, b = make(80), make(70)
    left = spark.createDataFrame(a, "k long, i long, s long, e long")
    right = spark.createDataFrame(b, "k long, j long, rs long, re long")
    got = {(r.i, r.j) for r in intervals.overlap_join(left, right, ["k"], ("s", "e"), ("rs", "re"), 100).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    union = {tuple(r) for r in intervals.union_intervals(left, ["k"], "s", "e", "i").collect()}
    want = set()
    for k in (0, 1):
        cells = sorted((x[2], x[3]) for x in a if x[0] == k)
        run = list(cells[0])
        for s, e in cells[1:]:
            if s <= run[1]:
                run[1] = max(run[1], e)
            else:
                want.add((k, *run))
                run = [s, e]
        want.add((k, *run))
    assert union == want
    free = {r.i for r in intervals.without_conflicts(left, ["k"], "s", "e", "i").collect()}
    assert free == {x[1] for x in a if not any(x[0] == y[0] and x[1] != y[1] and x[2] < y[3] and y[2] < x[3] for y in a)}
