"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueloom.shared import fresh_path

DELAY = "1 day"
BLOCK = 32768  # event ids whose flags are one state
USERS = 1024  # user ids whose attempts of one type are one state
UNKNOWN, NONE = -1, -2  # outcome of an attempt that has none; no such attempt
LAST = 2**63 - 1


def event_stream(spark: SparkSession, source: str, files: int = 64) -> DataFrame:
    """Event files as a stream; the time column becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(f"{source}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, tag: str, root: str | None = None) -> DataFrame:
    """Run all available input into a file sink and read it back; nothing passes the driver.

    A job with a ``root`` of its own goes on where it stopped: its checkpoint and output lie there, so a later
    call, of this process or another, reads only files that have come since.
    """
    spark = stream.sparkSession
    path, state = (f"{root}/out", f"{root}/state") if root else (fresh_path(spark, tag), fresh_path(spark, f"{tag}-state"))
    job = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def first_readings(events: DataFrame) -> DataFrame:
    """Late evidence, append only: one row per key within the watermark."""
    keyed = events.select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return keyed.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["user_id", "event_type", "k"])


def scenes(events: DataFrame, gap: str = "3 hours") -> DataFrame:
    """Pause-delimited sessions; the window state is merged per key, not collected."""
    windows = events.withWatermark("ts", DELAY).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("n")).select(
        "user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n"
    )


def stage_telemetry(events: DataFrame, width: str = "1 day") -> DataFrame:
    windows = events.withWatermark("ts", DELAY).groupBy("event_type", F.window("ts", width).alias("w"))
    return windows.agg(
        F.count("*").alias("requests"), F.sum(F.expr("cast(round(value * 1000) as bigint)")).alias("millis")
    ).select(F.col("event_type").alias("stage"), F.unix_micros("w.start").alias("start_us"), "requests", "millis")


def flag_changes(events: DataFrame) -> DataFrame:
    """Repeated flags as changes, so that events may come in any order and as late as they like.

    State is kept for BLOCK event ids, whoever their users are: which ids are flags and which are changes, so states
    are in proportion to events however many users there are.  Each call sends what its events change, flag by flag
    (+1 or -1), and the edges of each of its users inside the block under a new version.
    """

    def flagged(users: np.ndarray, nobody: np.ndarray, ids: np.ndarray, errors: np.ndarray) -> set[tuple]:
        hit = errors[1:] & errors[:-1] & (users[1:] == users[:-1]) & (nobody[1:] == nobody[:-1])
        return set(zip(users[1:][hit].tolist(), nobody[1:][hit].tolist(), ids[1:][hit].tolist(), strict=True))

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds = (np.int64, bool, np.int64, bool)  # user, without a user, event id, error
        version, held = 0, [np.empty(0, kind) for kind in kinds]
        if state.exists:
            version, *packed = state.get
            held = [np.frombuffer(column, kind) for column, kind in zip(packed, kinds, strict=True)]
        before = flagged(*held)
        rows = pd.concat(parts)
        new = [
            rows["who"].to_numpy(np.int64), rows["nobody"].to_numpy(bool), rows["event_id"].to_numpy(np.int64),
            (rows["event_type"] == "error").to_numpy(bool),
        ]
        touched = set(zip(new[0].tolist(), new[1].tolist(), strict=True))
        held = [np.concatenate(both) for both in zip(held, new, strict=True)]
        order = np.lexsort((held[2], held[0], held[1]))
        users, nobody, ids, errors = held = [column[order] for column in held]
        after = flagged(*held)
        state.update((version + 1, *(column.tobytes() for column in held)))
        out = [(u, n, key[0], i, 1, None, None, None) for u, n, i in sorted(after - before)]
        out += [(u, n, key[0], i, -1, None, None, None) for u, n, i in sorted(before - after)]
        opens = np.flatnonzero(np.append(True, (users[1:] != users[:-1]) | (nobody[1:] != nobody[:-1])))
        for first, last in zip(opens, np.append(opens[1:], len(ids)) - 1, strict=True):
            who = (int(users[first]), bool(nobody[first]))
            if who in touched:
                out.append((*who, key[0], int(ids[first]), 0, version + 1, bool(errors[first]), bool(errors[last])))
        frame = pd.DataFrame(out, columns=["who", "nobody", "block", "event_id", "sign", "version", "first", "last"])
        yield frame.astype({"version": "Int64", "first": "boolean", "last": "boolean"})

    marks = events.filter("event_type IN ('error', 'click')").select(
        F.floor(F.col("event_id") / BLOCK).alias("block"), F.coalesce("user_id", F.lit(0)).cast("bigint").alias("who"),
        F.col("user_id").isNull().alias("nobody"), "event_id", "event_type",
    )
    changes = marks.groupBy("block").applyInPandasWithState(
        follow, "who long, nobody boolean, block long, event_id long, sign int, version long, first boolean, last boolean",
        "version long, who binary, nobody binary, ids binary, errors binary", "append", GroupStateTimeout.NoTimeout,
    )
    return changes.select(F.when(~F.col("nobody"), F.col("who")).alias("user_id"), "block", "event_id", "sign", "version", "first", "last")


def repeated_flags(changes: DataFrame) -> DataFrame:
    """A line flagged again without a change in between, from the drained ``flag_changes``: the sum of the changes
    inside blocks, and the first flags of blocks whose last block before ends in one."""
    inside = changes.filter("sign <> 0").groupBy("user_id", "event_id").agg(F.sum("sign").alias("n")).filter("n > 0")
    edges = changes.filter("sign = 0").groupBy("user_id", "block").agg(
        F.max(F.struct("version", "event_id", "first", "last")).alias("e")
    )
    by_block = Window.partitionBy("user_id").orderBy("block")
    across = edges.select("user_id", "e.event_id", F.col("e.first").alias("flag"), F.lag("e.last").over(by_block).alias("flagged"))
    return inside.select("user_id", "event_id").union(across.filter("flag AND flagged").select("user_id", "event_id"))


def running_budget(closed: DataFrame, budget: int) -> DataFrame:
    """Time used by each stage up to the end of every closed window, and the window in which its budget ran out.

    ``closed`` are the windows of ``stage_telemetry``, which a watermark has closed; windows closed later are
    later ones, so the state of a stage is the time used so far.  ``crossed`` is true in one row of a stage at most.
    """

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(parts).sort_values("start_us")
        total = used + rows["millis"].cumsum()
        before = total - rows["millis"]
        state.update((int(total.iloc[-1]),))
        yield pd.DataFrame({
            "stage": key[0], "start_us": rows["start_us"], "used_ms": total, "over_budget": total > budget,
            "crossed": (total > budget) & (before <= budget),
        })

    return closed.groupBy("stage").applyInPandasWithState(
        follow, "stage string, start_us long, used_ms long, over_budget boolean, crossed boolean", "used long", "append",
        GroupStateTimeout.NoTimeout,
    )


def budget_job(events: DataFrame, budget: int, root: str | None = None) -> DataFrame:
    """``running_budget`` over a stream of events: two jobs in a row, the second reading the windows the first has
    closed.  All windows new to it come in one batch, so they are taken in their order."""
    spark = events.sparkSession
    root = root or fresh_path(spark, "budget")
    windows = stage_telemetry(events)
    drain(windows, "windows", f"{root}/windows")
    closed = spark.readStream.schema(windows.schema).parquet(f"{root}/windows/out")
    return drain(running_budget(closed, budget), "budget", f"{root}/budget")


def attempt_changes(events: DataFrame) -> DataFrame:
    """Resumable ledger as changes: what a key's two earliest attempts are, whenever that changes.

    What is known of a key are those two attempts (event id and outcome), so a finished key costs nothing more and
    late attempts with earlier ids still count.  The keys of USERS user ids and one event type are one state, which
    lives in the stream's checkpoint.
    """
    held_as = {"who": np.int64, "version": np.int64, "first": np.int64, "first_ok": np.int8, "second": np.int64, "second_ok": np.int8}

    def earliest(attempts: pd.DataFrame) -> pd.DataFrame:
        return attempts.sort_values("event_id", kind="stable").groupby("who").head(2)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed = state.get if state.exists else [b""] * len(held_as)
        held = pd.DataFrame({c: np.frombuffer(p, kind) for p, (c, kind) in zip(packed, held_as.items(), strict=True)})
        new = None
        for rows in parts:
            new = earliest(rows if new is None else pd.concat([new, rows]))
        known = [held[["who", n, f"{n}_ok"]].set_axis(["who", "event_id", "ok"], axis=1) for n in ("first", "second")]
        known = [k[k["ok"] != NONE] for k in known]
        columns = ["who", "event_id", "ok"]
        best = pd.concat([*known, new[columns]]).astype({"event_id": np.int64, "ok": np.int8}).drop_duplicates().sort_values(columns)
        at = best.groupby("who").cumcount()
        first, second = (best[at == n].set_index("who") for n in (0, 1))
        now = pd.DataFrame({
            "first": first["event_id"], "first_ok": first["ok"],
            "second": second["event_id"].reindex(first.index, fill_value=0), "second_ok": second["ok"].reindex(first.index, fill_value=NONE),
        })
        was = held.set_index("who").reindex(now.index, fill_value=0)
        changed = (was["version"] == 0) | (now != was[now.columns]).any(axis=1)
        now.insert(0, "version", was["version"] + changed)
        if changed.any():
            kept = now.reset_index()
            state.update(tuple(kept[c].to_numpy(kind).tobytes() for c, kind in held_as.items()))
            out = kept[changed.to_numpy()].assign(block=key[0], event_type=key[1])
            yield out[["block", "who", "event_type", "version", "first_ok", "second_ok"]].astype({"block": "Int64"})

    # Outcomes as 1, 0 and UNKNOWN; an attempt without an id comes after all others.
    attempts = events.select(
        F.floor(F.col("user_id") / USERS).alias("block"), F.coalesce("user_id", F.lit(0)).cast("bigint").alias("who"), "event_type",
        F.coalesce("event_id", F.lit(LAST)).cast("bigint").alias("event_id"),
        F.coalesce(F.expr("cast(round(value * 100) as bigint) % 3 <> 0").cast("int"), F.lit(UNKNOWN)).alias("ok"),
    )
    changes = attempts.groupBy("block", "event_type").applyInPandasWithState(
        follow, "block long, who long, event_type string, version long, first_ok int, second_ok int",
        ", ".join(f"{c} binary" for c in held_as), "append", GroupStateTimeout.NoTimeout,
    )
    outcome = lambda c: F.when(F.col(c) >= 0, F.col(c) == 1).alias(c)
    return changes.select(
        F.when(F.col("block").isNotNull(), F.col("who")).alias("user_id"), "event_type", "version", outcome("first_ok"), outcome("second_ok")
    )


def request_ledger(changes: DataFrame) -> DataFrame:
    """State of every key from the drained ``attempt_changes``: finished keys are skipped, a key gets one recovery
    attempt, then fails."""
    last = changes.groupBy("user_id", "event_type").agg(F.max(F.struct("version", "first_ok", "second_ok")).alias("v"))
    state = (
        F.when(F.col("v.first_ok"), "done").when(F.col("v.second_ok"), "recovered")
        .when(F.col("v.second_ok").isNotNull(), "failed").otherwise("pending")
    )
    return last.select("user_id", "event_type", state.alias("state"))
