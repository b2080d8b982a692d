"""Fuzzy text alignment: bigram set-similarity join, monotone anchors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueloom.operators import ordered
from cueloom.operators.segments import State, fold
from cueloom.shared import pin, ship

MATCH, EQUIVALENT, CONTAINED = 600_000, 920_000, 930_000  # fixed values, in millionths
JITTER, REACH, MAX_RUN = 5, 80, 4  # fixed values: window around the last accepted sentence
#: Texts and bigrams in a block, tokens counted at once.
CELL, CELL_TOKENS, CHUNK = 1024, 500_000, 4096


def bigram_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def numbered(owner: np.ndarray, points: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token) of all bigrams of texts laid end to end; ``gaps`` marks places where a text ends.

    The n-th copy of a bigram in an owner is a token of its own, so multiset intersection is plain set
    intersection.  Two code points and the copy number are packed in one integer: exact, and cheap to compare.
    """
    grams = (points[:-1].astype(np.int64) << 42) + (points[1:].astype(np.int64) << 21)
    own, grams = owner[:-1][~gaps[:-1]], grams[~gaps[:-1]]
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    at = np.arange(len(own))
    return own, grams + (at - np.maximum.accumulate(np.where(fresh, at, 0))) + 1


def _tokens(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(i, text) for i, own in enumerate(texts) for text in own if text]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer("".join(text for _, text in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(text) for _, text in parts])
    gaps = np.zeros(len(points), bool)
    gaps[np.cumsum(sizes) - 1] = True
    return numbered(np.repeat([i for i, _ in parts], sizes), points, gaps)


def _shared(a: tuple[np.ndarray, np.ndarray], n: int, b: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """n x m numbers of common tokens, some thousand tokens at a time."""
    out = np.zeros((n, m), np.int64)
    common = np.intersect1d(a[1], b[1])
    sides = []
    for (owner, token), rows in ((a, n), (b, m)):
        at = np.searchsorted(common, token)
        held = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == token) if len(common) else np.zeros(len(token), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((owner[held][order], at[held][order], rows))
    for low in range(0, len(common), CHUNK):
        dense = []
        for owner, at, rows in sides:
            first, last = np.searchsorted(at, (low, low + CHUNK))
            part = np.zeros((rows, min(CHUNK, len(common) - low)), np.float32)
            part[owner[first:last], at[first:last] - low] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _edges() -> list[int]:
    """Least sizes of classes in which the largest size is less than 5/4 of the least, for all sizes of a text."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4))
    return edges


def _blocks(df: DataFrame, key: str, text: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Texts with their block, and the blocks with their least and largest size.

    A block holds texts of about one size, ``CELL`` of them and ``CELL_TOKENS`` bigrams on average.
    """
    sized = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(text).alias(f"_t_{tag}")).withColumn(
        "_size", F.expr(f"aggregate(_t_{tag}, 0L, (n, t) -> n + greatest(0, char_length(t) - 1))")
    ).filter("_size > 0")
    edges = F.array(*[F.lit(e).cast("bigint") for e in _edges()])
    classed = pin(sized.withColumn("_class", F.size(F.filter(edges, lambda e: e <= F.col("_size")))), "texts")
    cuts = classed.groupBy("_class").agg(
        F.expr(f"greatest((count(*) + {CELL - 1}) div {CELL}, (sum(_size) + {CELL_TOKENS - 1}) div {CELL_TOKENS})").alias("_cuts"),
        F.min("_size").alias(f"_lo_{tag}"), F.max("_size").alias(f"_hi_{tag}"),
    )
    name = F.struct("_class", F.pmod(F.xxhash64(key), F.col("_cuts")).alias("_part")).alias(f"_b_{tag}")
    texts = classed.join(F.broadcast(cuts.select("_class", "_cuts")), "_class").select(name, F.col(key), f"_t_{tag}")
    blocks = cuts.withColumn("_part", F.explode(F.expr("sequence(0L, _cuts - 1)"))).select(
        F.struct("_class", "_part").alias(f"_b_{tag}"), f"_lo_{tag}", f"_hi_{tag}"
    )
    return texts, blocks


def dice_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str) -> DataFrame:
    """All pairs with Dice of at least 0.6, exact.

    Both sides are cut into blocks of texts of about one size.  Sizes of a pair differ by less than 7/3, so only
    blocks that hold such sizes make a cell; a cell counts the common bigrams of all its pairs in one matrix
    product.  Only pairs that match become rows.  Cells are of bounded size, however many texts there are.
    Equal texts must be collapsed by the caller.
    """
    ship(left.sparkSession)
    (ta, ba), (tb, bb) = _blocks(left, left_key, text, "a"), _blocks(right, right_key, text, "b")
    cells = ba.join(bb, F.expr("3 * _lo_a <= 7 * _hi_b AND 3 * _lo_b <= 7 * _hi_a")).select("_b_a", "_b_b")
    sides = [
        texts.join(cells, block).select("_b_a", "_b_b", F.col(key), F.col(own))
        for texts, block, key, own in ((ta, "_b_a", left_key, "_t_a"), (tb, "_b_b", right_key, "_t_b"))
    ]
    kinds = [left.schema[left_key].dataType, right.schema[right_key].dataType]
    schema = T.StructType([
        T.StructField(left_key, kinds[0]), T.StructField(right_key, kinds[1]),
        *[T.StructField(c, T.LongType()) for c in ("shared", "left_size", "right_size", "dice")],
    ])
    target = to_arrow_schema(schema)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        n, m = a.num_rows, b.num_rows
        own, other = _tokens(a["_t_a"].to_pylist()), _tokens(b["_t_b"].to_pylist())
        sizes, sizes_b = np.bincount(own[0], minlength=n), np.bincount(other[0], minlength=m)
        shared = _shared(own, n, other, m)
        dice = 2_000_000 * shared // (sizes[:, None] + sizes_b[None, :])
        i, k = np.nonzero(dice >= MATCH)
        columns = [a[left_key].combine_chunks().take(pa.array(i)), b[right_key].combine_chunks().take(pa.array(k))]
        columns += [pa.array(c, pa.int64()) for c in (shared[i, k], sizes[i], sizes_b[k], dice[i, k])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    by = ["_b_a", "_b_b"]
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(cell, schema)


def match_status(exact: Column) -> Column:
    cover = F.greatest(F.expr("1000000 * shared div left_size"), F.expr("1000000 * shared div right_size"))
    return F.when(exact | (F.col("dice") >= EQUIVALENT) | (cover >= CONTAINED), "high").otherwise("mismatch")


def sentence_runs(sentences: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Runs of one to four consecutive sentences, by equi-joins on the next number."""
    runs = sentences.select(key, F.col(number).alias("idx"), F.lit(1).alias("span"), F.col(text).alias("run"))
    out = runs
    for span in range(2, MAX_RUN + 1):
        nxt = sentences.select(key, (F.col(number) - (span - 1)).alias("idx"), F.col(text).alias("_more"))
        runs = runs.join(nxt, [key, "idx"]).select(key, "idx", F.lit(span).alias("span"), F.concat("run", "_more").alias("run"))
        out = out.unionByName(runs)
    return out


def monotone_anchors(scored: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Accept per line the best run near the last accepted one (5 back, 80 ahead).

    ``scored`` has one row per (line, idx, span) with ``dice``; the fold walks candidates in
    line order and settles a line when the next one begins.
    """
    last = scored.groupBy(*keys).agg((F.max(line) + 1).alias(line)).select(
        *keys, line, F.lit(0).cast("bigint").alias("idx"), F.lit(0).alias("span"), F.lit(0).cast("bigint").alias("dice")
    )
    rows = scored.select(*keys, line, "idx", "span", "dice").unionByName(last)

    def advance(state: State, row: tuple) -> tuple[State, list[tuple]]:
        here, idx, span, dice = (int(v) for v in row)
        prev, at, best = [None, None, None] if state is None else state
        made = []
        if at is not None and here != at:
            if best is not None:
                made.append((at, best[1], best[2], best[0]))
                prev = best[1] + best[2] - 1
            best = None
        inside = prev is None or max(1, prev - JITTER) <= idx < prev + REACH
        if inside and dice >= MATCH and (best is None or dice > best[0]):
            best = [dice, idx, span]
        return [prev, here, best], made

    cut = ordered.dense_blocks(rows, line, 256)
    return fold(
        cut, keys, [line, "idx", "span"], [line, "idx", "span", "dice"], advance,
        {"anchor_line": "long", "anchor": "long", "anchor_span": "long", "anchor_dice": "long"},
    ).withColumnsRenamed({"anchor_line": line, "anchor": "idx", "anchor_span": "span", "anchor_dice": "dice"})
