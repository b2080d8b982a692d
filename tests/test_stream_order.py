"""Streams whose files come in another order than their events."""

import random

from pyspark.sql import functions as F

from cueloom.streaming import jobs


def test_repeated_flags_in_any_file_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 64)
    rng = random.Random(2)
    rows = [(k, rng.randint(1, 3), rng.choice(["error", "error", "click", "view"])) for k in rng.sample(range(400), 300)]
    folder = tmp_path / "events.parquet"
    schema = "event_id long, user_id long, event_type string"
    for k in range(6):
        part = spark.createDataFrame(rows[k::6], schema).withColumn("ts", F.timestamp_seconds("event_id"))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    changes = jobs.flag_changes(jobs.event_stream(spark, str(folder) + "/", files=1))
    got = {tuple(r) for r in jobs.repeated_flags(jobs.drain(changes, "shuffled")).collect()}
    want, flagged = set(), {}
    for event_id, user, kind in sorted(rows):
        if kind == "error" and flagged.get(user):
            want.add((user, event_id))
        if kind != "view":
            flagged[user] = kind == "error"
    assert got == want


def write(spark, rows, folder):
    """One file of (event_id, user_id, event_type, value, second)."""
    schema = "event_id long, user_id long, event_type string, value double, s long"
    made = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    made.coalesce(1).write.mode("append").parquet(str(folder))


def test_ledger_goes_on_after_a_stop(spark, tmp_path):
    """Stopped and started again over files that came late, with earlier and later attempts."""
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 12), rng.choice("ab"), rng.randint(0, 8) / 100, k) for k in rng.sample(range(1000), 90)]
    folder, root = tmp_path / "in", f"file://{tmp_path}/ledger"
    versions = []
    for cut in (rows[:30], rows[30:60], rows[60:]):
        write(spark, cut, folder)
        stream = jobs.event_stream(spark, str(folder) + "/", files=1)
        changes = jobs.drain(jobs.attempt_changes(stream), "ledger", root)
        versions.append(changes.agg(F.max("version")).first()[0])
    got = {(r.user_id, r.event_type): r.state for r in jobs.request_ledger(changes).collect()}
    want = {}
    for key in {(u, e) for _, u, e, _, _ in rows}:
        ok = [round(v * 100) % 3 != 0 for i, u, e, v, _ in sorted(rows) if (u, e) == key][:2]
        want[key] = "done" if ok[0] else "pending" if len(ok) == 1 else "recovered" if ok[1] else "failed"
    assert got == want
    assert versions[0] < versions[-1]  # versions went on from the state of the run before
    assert changes.filter("version = 1").count() == len(want)


def test_budget_crossed_once_over_a_restart(spark, tmp_path):
    day = 86_400
    folder, root = tmp_path / "in", f"file://{tmp_path}/budget"
    rows = [(d * 10 + k, 1, "ab"[k % 2], 1.0 + d, d * day + k) for d in range(8) for k in range(4)]
    for cut in (rows[:12], rows[12:]):
        write(spark, cut, folder)
        out = jobs.budget_job(jobs.event_stream(spark, str(folder) + "/", files=1), 9_000, root)
    got = {(r.stage, r.start_us // 86_400_000_000): (r.used_ms, r.over_budget, r.crossed) for r in out.collect()}
    used, want = 0, {}
    for d in range(6):  # the watermark closes what ended a day before the last event
        used, before = used + 2000 * (1 + d), used
        for stage in "ab":
            want[stage, d] = (used, used > 9000, used > 9000 >= before)
    assert got == want and len(got) == out.count()
