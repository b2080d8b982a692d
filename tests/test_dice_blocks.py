"""The Dice join over blocks of texts: any block size, copies, nulls and texts without bigrams."""

import random
from collections import Counter

import pytest

from cueloom.operators import align


def _dice(a: str, b: str) -> tuple[int, int]:
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    shared = sum((x & y).values())
    return shared, 2_000_000 * shared // max(1, sum(x.values()) + sum(y.values())) if x and y else 0


@pytest.mark.parametrize(("cell", "tokens", "chunk"), [(3, 40, 2), (1024, 500_000, 4096)])
def test_pairs_do_not_depend_on_blocks(spark, monkeypatch, cell, tokens, chunk):
    for name, value in (("CELL", cell), ("CELL_TOKENS", tokens), ("CHUNK", chunk)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab😀語") for _ in range(rng.choice((1, 2, 5, 9, 30)))) for _ in range(40)] + ["aaaa" * 9, ""]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "abab")], "l long, t string")
    right = spark.createDataFrame([(f"r{i}", t + "a") for i, t in enumerate(texts)] + [(None, "abab")], "r string, t string")
    found = align.dice_join(left, right, "l", "r", "t")
    got = sorted((r.l, r.r, r.shared, r.left_size, r.right_size, r.dice) for r in found.collect())
    want = [
        (i, f"r{j}", shared, len(a) - 1, len(b), dice) for i, a in enumerate(texts) for j, b in enumerate(texts)
        for shared, dice in [_dice(a, b + "a")] if dice >= 600_000
    ]
    assert got == sorted(want)


def test_pairs_below_the_bound_are_no_rows(spark):
    """Texts of the same frequent bigrams that do not match: no join of the plan makes a row for each pair."""
    texts = [("th" * 8 + chr(0x4E00 + i) * 60 + "er" * 8,) for i in range(120)]
    df = spark.createDataFrame(texts, "t string").selectExpr("sha2(t, 256) AS k", "t")
    found = align.dice_join(df, df.withColumnRenamed("k", "q"), "k", "q", "t")
    assert found.count() == 120
    plan = found._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan and "array_intersect" not in plan
