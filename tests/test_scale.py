"""Work and state in proportion to rows: texts, keys, users and batches that are large or many."""

from pyspark.sql import functions as F

from cueloom.plans.catalogue import PLANS


def tables(spark, folder, **made):
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_parts_do_not_carry_their_text(spark, tmp_path):
    """A text of many parts is one row throughout; as rows, each part held all of it."""
    rows = [(1, "a b  c"), (3, "a b"), (11, "ab"), (4, None), (5, ""), (6, "x y"), (6, "x y"), (8, "w " * 5000)]
    sf = tables(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    parts = PLANS["val11_exact_parts"](spark, sf)
    assert {tuple(r) for r in parts.collect()} == {(1, 4, True), (3, 2, False), (11, 1, True), (5, 1, True), (6, 4, False), (8, 5001, True)}
    assert "Generate" not in parts._jdf.queryExecution().executedPlan().toString()


def test_blocks_follow_the_rows_of_a_key(spark):
    """Keys of few rows are one block however far apart these lie; longer ones are cut."""
    from cueloom.operators import ledger, ordered

    rows = [(k, 1000 * i + k, "issue" if i % 2 else "persists") for k in range(20) for i in range(6)]
    rows += [(99, 7 * i, ["issue", "persists", "repair", "resolved"][i % 4]) for i in range(100)] + [(None, 5, "issue"), (None, None, "issue")]
    log = spark.createDataFrame(rows, "k long, no long, ev string")
    cut = ordered.key_blocks(log, ["k"], "no", 10)
    blocks = {r.k: (r.n, r.most) for r in cut.groupBy("k", "_block").count().groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert blocks == {**{k: (1, 6) for k in range(20)}, 99: (10, 10), None: (1, 2)}
    states = lambda df: sorted(map(tuple, ledger.issue_states(df.filter("k IS NOT NULL"), ["k"], ["no"], "ev").collect()))
    assert states(cut) == states(ordered.dense_blocks(log, "no", 10**6))


def states_and_rows(spark, tmp_path, job, rows, files):
    """Rows in the state store and the drained changes, after files in turn."""
    from cueloom.streaming import jobs

    schema = "event_id long, user_id long, event_type string, value double"
    for k in range(files):
        part = spark.createDataFrame(rows[k::files], schema).withColumn("ts", F.timestamp_seconds("event_id"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/job"
    out = jobs.drain(job(jobs.event_stream(spark, f"{tmp_path}/in/", files=1)), "t", root)
    return spark.read.format("statestore").load(f"{root}/state").count(), out


def test_flags_of_many_users_are_few_states(spark, tmp_path, monkeypatch):
    from cueloom.streaming import jobs

    monkeypatch.setattr(jobs, "BLOCK", 100)
    rows = [(i, None if i % 41 == 0 else i * 7 % 40, "error" if i % 3 else "click", 0.0) for i in range(300)]
    states, changes = states_and_rows(spark, tmp_path, jobs.flag_changes, rows, 3)
    assert states == 3  # one of a user and block would be over a hundred
    last, want = {}, set()
    for i, user, kind, _ in rows:
        if kind == "error" and last.get(user) == "error":
            want.add((user, i))
        last[user] = kind
    assert {tuple(r) for r in jobs.repeated_flags(changes).collect()} == want


def test_attempts_of_many_users_are_few_states(spark, tmp_path, monkeypatch):
    from cueloom.streaming import jobs

    monkeypatch.setattr(jobs, "USERS", 50)
    rows = [(i, None if i % 29 == 0 else i * 7 % 90, "ab"[i % 2], None if i % 31 == 0 else i % 9 / 100) for i in range(300)]
    states, changes = states_and_rows(spark, tmp_path, jobs.attempt_changes, rows, 3)
    assert states == 6  # two types of the users under 50, the others, and events without a user
    want = {}
    for key in {(u, e) for _, u, e, _ in rows}:
        ok = [None if v is None else round(v * 100) % 3 != 0 for _, u, e, v in rows if (u, e) == key][:2]
        second = ok[1] if len(ok) > 1 else None
        want[key] = "done" if ok[0] else "recovered" if second else "failed" if second is False else "pending"
    assert {(r.user_id, r.event_type): r.state for r in jobs.request_ledger(changes).collect()} == want


def test_batches_are_taken_in_stretches(monkeypatch):
    """A worker makes the words and places of some texts at a time, not of a batch."""
    import pyarrow as pa

    from cueloom import shared

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["a" * 40, None, "b" * 70, "", "c" * 300, "d", "é" * 60]})
    cut = [b.column(0).to_pylist() for b in shared.by_size(batch, 1, 100)]
    assert cut == [[0, 1], [2, 3], [4], [5], [6]]
    assert list(shared.by_size(batch.slice(0, 0), 1)) == []
    seen = []
    double = lambda a: (seen.append(len(a)), pa.array([2 * v for v in a.to_pylist()], pa.int64()))[1]
    assert shared.in_pieces(double, batch.column(0), rows=3).to_pylist() == [0, 2, 4, 6, 8, 10, 12] and seen == [3, 3, 1]
    assert shared.in_pieces(double, batch.column(0).slice(0, 0)).to_pylist() == []


def test_words_are_made_where_their_arcs_are(spark):
    """With one block of readings no arcs leave the worker, and the first side of a conflict goes on as its reading."""
    from cueloom.operators import readings

    words = spark.createDataFrame([("山", "やま", 1), ("山川", "さんせん", 1)], "surface string, reading string, cost long")
    read = readings.read_words(spark.createDataFrame([(1, "山川山")], "k long, t string"), "t", words, ["k"])
    assert [w.reading for w in read.first().words] == ["さんせん", "やま"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "_arcs" not in plan and "ArrowEvalPython" not in plan


def test_support_counts_pairs_with_the_chosen_only(spark):
    from cueloom.operators import consensus

    rows = [(1, 1, 2, "abcab"), (1, 2, 2, "abca"), (1, 3, 2, "xyz"), (1, 4, 2, "a"), (2, 5, 5, "ab")]
    df = spark.createDataFrame(rows, "w long, id long, c long, _c string")
    some = consensus._shared_bigrams(df, ["w"], "id", "c")
    assert {tuple(r) for r in some.collect()} == {(1, 1, 2, 3), (1, 3, 2, 0), (1, 4, 2, 0)}
    every = {tuple(r) for r in consensus._shared_bigrams(df, ["w"], "id").collect()}
    assert len(every) == 12 and {(1, 1, 2, 3), (1, 2, 1, 3)} <= every


def test_choice_does_not_join_texts(spark):
    """Lengths stand for texts once bigrams are counted; texts too short for one are compared themselves."""
    from cueloom.operators import consensus

    rows = [(1, 1, "あ"), (1, 2, "あ"), (1, 3, "い"), (2, 1, "abcdef"), (2, 2, "abcdxx"), (3, 1, "")]
    chosen = consensus.choose_reading(spark.createDataFrame(rows, "w long, id long, text string"), ["w"], "id")
    assert {r.w: (r.chosen, r.score) for r in chosen.collect()} == {1: (1, 850_000), 2: (1, 600_000), 3: (1, 0)}
    assert "MapInPandas" not in (plan := chosen._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan


def test_characters_of_a_text_are_no_rows(spark):
    from cueloom.operators import layout

    rows = [(1, "One, two. Three! … Four"), (2, "...!? "), (3, None), (4, "a. b. c."), (5, "。あ。い")]
    parts = layout.restore_parts(spark.createDataFrame(rows, "k long, t string"), ["k"], "t")
    got = {}
    for r in sorted(parts.collect()):
        got.setdefault(r.k, []).append(r.part)
    assert got == {1: ["One, two. ", "Three! … ", "Four"], 4: ["a. ", "b. ", "c."], 5: ["。あ。", "い"]}
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_script_lines_are_stripped_once(spark):
    from cueloom.functions import text as tx

    trims = lambda c: str(c).lower().count("trim") + str(c).lower().count("regexp_replace")
    assert trims(tx.script_sentences(F.col("t"))) <= 2 * trims(tx.strip(F.col("t"))) + 1
