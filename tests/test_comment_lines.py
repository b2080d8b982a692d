"""Comments are read line by line: white space of any kind, marks, and one pass of each pattern."""

import random

from pyspark.sql import functions as F

from cueloom.functions import parsing, text as tx


def test_strip_takes_the_white_space_of_the_pattern(spark):
    rng = random.Random(7)
    texts = [("".join(rng.choice([*tx.SPACES, "a", "語", "​", "﻿"]) for _ in range(rng.randrange(0, 9))),) for _ in range(400)]
    df = spark.createDataFrame([*texts, (None,)], "s string")
    both = df.select(tx.strip(F.col("s")).alias("a"), F.regexp_replace("s", f"^{tx.SPACE}+|{tx.SPACE}+$", "").alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_each_line_is_read_once(spark):
    answer = "- [1] a　\n\n 2: b \r\n無\n- 無\n第9行: c\n[99999999999999999999] d\n3: \n4:" + "x" * 170 + "\n无"
    df = spark.createDataFrame([(1, answer, 3), (2, None, 1)], "k long, a string, n int")
    found = parsing.comments(df, ["k"], "a", "n")
    got = [(r.k, r.at, r.line, r.note, r.in_range) for r in found.orderBy("at").collect()]
    assert got == [
        (1, 0, 1, "a", True), (1, 2, 2, "b", True), (1, 5, 9, "c", False), (1, 6, None, "d", False),
        (1, 8, 4, "x" * 159 + "…", False),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:[-*•·]|") == 1
