"""Integer time: milliseconds and sample frames, never doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RATE = 16000  # fixed value: detector sample rate
STAMP = r"^\s*(\d{2,}):([0-5]\d):([0-5]\d),(\d{3})\s*$"


def parse_ms(stamp: Column, pattern: str = STAMP) -> Column:
    """``HH:MM:SS,mmm`` to milliseconds; null when the text is not a timestamp."""
    def part(i: int) -> Column:
        return F.regexp_extract(stamp, pattern, i).cast("bigint")

    value = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)
    return F.when(stamp.rlike(pattern), value)


def format_ms(ms: Column) -> Column:
    ms = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000).cast("bigint"),
        F.pmod(F.floor(ms / 60000).cast("bigint"), F.lit(60).cast("bigint")),
        F.pmod(F.floor(ms / 1000).cast("bigint"), F.lit(60).cast("bigint")),
        F.pmod(ms, F.lit(1000).cast("bigint")),
    )


def cue_line(start: Column, end: Column) -> Column:
    return F.concat(format_ms(start), F.lit(" --> "), format_ms(end))


def clock(ms: Column) -> Column:
    """``MM:SS.cc`` with hundredths cut, as shown beside readings."""
    ms = ms.cast("bigint")
    return F.format_string(
        "%02d:%02d.%02d",
        F.floor(ms / 60000).cast("bigint"),
        F.pmod(F.floor(ms / 1000).cast("bigint"), F.lit(60).cast("bigint")),
        F.floor(F.pmod(ms, F.lit(1000).cast("bigint")) / 10).cast("bigint"),
    )


def frames(ms: Column, rate: int = RATE) -> Column:
    return ms.cast("bigint") * (rate // 1000)
