"""Timing repair carries the values of a run along one order and one back."""

from cueloom.operators import timing


def test_repair_sorts_units_once_each_way(spark):
    rows = [(k, n, text, at, at + size, 0, 9000) for k in (1, 2) for n, (text, at, size) in enumerate(
        [("aaaa", 0, 400), ("bbbbbb", 400, 20), ("cc", 420, 5), ("dddd", 900, 600), ("eeee", 1500, 10), ("ffffffff", 1510, 5000)], 1)]
    units = spark.createDataFrame(rows, "k long, no long, text string, start_ms long, end_ms long, lo long, hi long")
    fixed = timing.repair(units, ["k"], "no", "text", ("lo", "hi"))
    got = [(r.start_ms, r.end_ms, r.repaired) for r in fixed.filter("k = 2").orderBy("no").collect()]
    assert got == [(0, 400, False), (400, 775, True), (775, 900, True), (900, 1500, False), (1500, 1510, True), (1510, 6510, False)]
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


def test_units_at_one_place_belong_to_one_run(spark):
    """Two copies of a text: every copy gets the times of a run that holds both."""
    rows = [(n, text, at + copy, at + copy + size, 0, 9000) for n, (text, at, size) in enumerate(
        [("a" * 14, 0, 900), ("bbbbbb", 900, 20), ("d" * 12, 1400, 800), ("eeee", 2200, 10)], 1) for copy in (0, 0)]
    units = spark.createDataFrame(rows, "no long, text string, start_ms long, end_ms long, lo long, hi long").selectExpr("1L AS k", "*")
    fixed = timing.repair(units, ["k"], "no", "text", ("lo", "hi")).filter("repaired").orderBy("no", "start_ms").collect()
    assert [(r.no, r.end_ms - r.start_ms) for r in fixed] == [(2, fixed[0].end_ms - fixed[0].start_ms)] * 2 + [(4, fixed[2].end_ms - fixed[2].start_ms)] * 2
    assert len({(r.no, r.start_ms, r.end_ms) for r in fixed}) == 2
