"""Streaming queries, each with the SQL of its batch twin over closed windows."""

from __future__ import annotations

from cueloom.plans.registry import query
from cueloom.streaming import jobs


def events(spark, sf):
    return jobs.event_stream(spark, f"{sf}/events.parquet")


@query("str1_late_evidence", "SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def late_evidence(spark, sf):
    """Compared as a key set: which copy survives is not ordered on a stream."""
    return jobs.drain(jobs.first_readings(events(spark, sf)), "str1").select("user_id", "event_type", "k").distinct()


@query("str2_scenes", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
f AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 3 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM f WHERE end_us // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM events)""")
def scenes(spark, sf):
    return jobs.drain(jobs.scenes(events(spark, sf)), "str2")


@query("str3_request_ledger", """WITH r AS (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) % 3 <> 0 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, CASE WHEN bool_or(ok AND n = 1) THEN 'done' WHEN bool_or(ok) THEN 'recovered' WHEN count(*) > 1 THEN 'failed' ELSE 'pending' END AS state FROM r WHERE n <= 2 GROUP BY 1, 2""")
def request_ledger(spark, sf):
    return jobs.request_ledger(jobs.drain(jobs.attempt_changes(events(spark, sf)), "str3"))


@query("str4_stage_telemetry", """SELECT event_type AS stage, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS requests, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS millis FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stage_telemetry(spark, sf):
    return jobs.drain(jobs.stage_telemetry(events(spark, sf)), "str4")


@query("str4_running_budget", """WITH w AS (SELECT event_type AS stage, epoch_us(date_trunc('day', ts)) AS start_us, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS millis FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2),
u AS (SELECT *, CAST(sum(millis) OVER (PARTITION BY stage ORDER BY start_us) AS BIGINT) AS used_ms FROM w)
SELECT stage, start_us, used_ms, used_ms > 2000000 AS over_budget, used_ms > 2000000 AND used_ms - millis <= 2000000 AS crossed FROM u""")
def running_budget(spark, sf):
    return jobs.budget_job(events(spark, sf), 2_000_000)


@query("str5_repeated_flags", """WITH f AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type IN ('error', 'click'))
SELECT user_id, event_id FROM f WHERE event_type = 'error' AND p = 'error'""")
def repeated_flags(spark, sf):
    return jobs.repeated_flags(jobs.drain(jobs.flag_changes(events(spark, sf)), "str5"))
