"""Interval joins with intervals of very different lengths."""

import random

from pyspark.sql import functions as F

from cueloom.operators import intervals

YEAR = 365 * 86_400_000


def test_long_intervals_make_few_rows(spark):
    rng = random.Random(6)
    left = [(1, -YEAR, 2 * YEAR), (2, 5, 6)] + [(k, s, s + rng.choice([0, 1, 20_000, 300_000])) for k in range(3, 60) for s in [rng.randint(-50_000, 2_000_000)]]
    right = [(1, 0, YEAR), (2, 10, 10), (3, -YEAR, -YEAR + 1)] + [(k, s, s + rng.randint(0, 60_000)) for k in range(4, 60) for s in [rng.randint(-50_000, 2_000_000)]]
    a = spark.createDataFrame(left, "l long, ls long, le long").withColumn("k", F.lit(1))
    b = spark.createDataFrame(right, "r long, rs long, re long").withColumn("k", F.lit(1))
    want = {(x, y) for x, xs, xe in left for y, ys, ye in right if xs < ye and ys < xe and xs < xe and ys < ye}
    for width in (1, 250, 20_000):
        got = intervals.overlap_join(a, b, ["k"], ("ls", "le"), ("rs", "re"), width).select("l", "r").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    leveled = a.filter("ls < le").withColumn("_level", intervals.level_of("ls", "le", 20_000))
    spread = intervals._on_levels(leveled, F.col("ls"), F.col("le") - 1, 20_000, intervals._wider(list(range(30)), F.col("_level"), True))
    assert spread.groupBy("l").count().agg(F.max("count")).first()[0] <= 60


def test_points_in_long_and_short_spans(spark):
    rng = random.Random(7)
    spans = [(1, -YEAR, YEAR), (2, 100, 101), (3, 7, 7)] + [(k, s, s + rng.randint(1, 5000)) for k in range(4, 50) for s in [rng.randint(-9000, 9000)]]
    points = [(p, rng.randint(-10_000, 10_000)) for p in range(80)] + [(90, 100), (91, 101), (92, -YEAR), (93, YEAR)]
    a = spark.createDataFrame(points, "p long, at long").withColumn("k", F.lit(1))
    b = spark.createDataFrame(spans, "i long, s long, e long").withColumn("k", F.lit(1))
    got = [tuple(r) for r in intervals.point_join(a, b, ["k"], "at", ("s", "e"), 300).select("p", "i").collect()]
    want = [(p, i) for p, at in points for i, s, e in spans if s <= at < e]
    assert sorted(got) == sorted(want)
    nothing = b.limit(0)
    assert intervals.point_join(a, nothing, ["k"], "at", ("s", "e"), 300).count() == 0
    assert intervals.overlap_join(nothing, a.selectExpr("k", "at AS rs", "at + 5 AS re"), ["k"], ("s", "e"), ("rs", "re"), 9).count() == 0
