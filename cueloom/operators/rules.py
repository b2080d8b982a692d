"""Dataset constraints: every check returns its violations as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cueloom.operators import ordered
from cueloom.sources.files import MEDIA


def finding(rule: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), detail.cast("bigint").alias("detail")))


def listed(*findings: Column) -> Column:
    return F.inline(F.array_compact(F.array(*findings)))


def tiling_violations(
    tiles: DataFrame, keys: Sequence[str], number: str, start: str, end: str, longest: int,
    media_end: Callable[[Column], Column], tail: int,
) -> DataFrame:
    """Windows must follow each other exactly, be short enough and reach the end of the media."""
    cut = ordered.dense_blocks(tiles, number)
    seen = ordered.scan(
        cut, keys, [number],
        lag={"_prev_end": F.col(end), "_prev_no": F.col(number)}, lead={"_next_no": F.col(number)},
    )
    a, b, p = F.col(start), F.col(end), F.col("_prev_end")
    short = media_end(F.col(number)) - b
    return seen.select(
        *keys, number,
        listed(
            finding("gap", a > p, a - p),
            finding("overlap", a < p, a - p),
            finding("late_start", p.isNull() & (a != 0), a),
            finding("over_30s", b - a > longest, b - a),
            finding("id_jump", F.col(number) != F.col("_prev_no") + 1, F.col(number) - F.col("_prev_no")),
            finding("short_of_end", F.col("_next_no").isNull() & (F.abs(short) > tail), short),
        ),
    )


def display_findings(cues: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Timing lint of a finished subtitle list (milliseconds; 0.4 s and 10 s are fixed values)."""
    seen = ordered.scan(cues, keys, [number], lag={"_prev": F.col("end_ms")})
    span = F.col("end_ms") - F.col("start_ms")
    kinds = F.array_compact(
        F.array(
            F.when(span <= 0, "nonpositive"),
            F.when(F.col("start_ms") < F.coalesce("_prev", F.lit(0)), "overlap"),
            F.when(span < 400, "short-cue"),
            F.when(span > 10000, "long-cue"),
        )
    )
    return seen.select(*keys, number, F.explode(kinds).alias("kind"))


def one_sided(left: DataFrame, right: DataFrame, keys: Sequence[str], left_rule: str, right_rule: str) -> DataFrame:
    """Keys present on one side only, both ways."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("rule", F.lit(left_rule)).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("rule", F.lit(right_rule))
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference both ways, for replay checks."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.select(left.columns).exceptAll(left).withColumn("side", F.lit("right")))


def deliverable_findings(listing: DataFrame, unit: str, name: str) -> DataFrame:
    """Pair media, source and translated subtitles of a unit by stem and language code."""
    subtitle = listing.filter(F.lower(name).endswith(".srt"))
    media = listing.filter(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*MEDIA)).select(
        unit, F.col(name).alias("media"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem")
    )
    # A source is <stem>.srt, a translation <stem>.<language>.srt; equi-joins on the stem.
    source = subtitle.select(unit, name, F.regexp_replace(name, r"(?i)\.srt$", "").alias("stem"))
    language = r"(?i)^(.+)\.([A-Z]{2,3}(?:-[A-Z0-9]{1,8})*)\.srt$"
    coded = subtitle.filter(F.col(name).rlike(language) & ~F.lower(F.regexp_extract(name, language, 2)).startswith("pre-"))
    target = coded.select(unit, name, F.regexp_extract(name, language, 1).alias("stem"))
    stems = media.select(unit, "stem").distinct()
    assigned = source.join(stems, [unit, "stem"], "left_semi").unionByName(target.join(stems, [unit, "stem"], "left_semi"))
    has_source = source.select(unit, "stem").distinct().withColumn("_src", F.lit(True))
    has_target = target.select(unit, "stem").distinct().withColumn("_tra", F.lit(True))
    paired = media.join(has_source, [unit, "stem"], "left").join(has_target, [unit, "stem"], "left")
    kind = (
        F.when(F.col("_src").isNull() & F.col("_tra").isNotNull(), "missing-source")
        .when(F.col("_src").isNull(), "no-speech-subtitles")
        .when(F.col("_tra").isNull(), "missing-translation")
    )
    found = paired.select(unit, F.col("media").alias(name), kind.alias("kind")).filter("kind IS NOT NULL")
    orphans = subtitle.join(assigned.select(unit, name), [unit, name], "left_anti")
    return found.unionByName(orphans.select(unit, name, F.lit("orphan-subtitles").alias("kind")))
