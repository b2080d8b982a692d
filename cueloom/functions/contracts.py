"""Row contracts as Column expressions that name the broken rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def status_rule(status: Column, text: Column) -> Column:
    """``ok`` needs text, ``empty`` and ``unavailable`` must not have any."""
    return (
        F.when(~status.isin("ok", "empty", "unavailable"), "unknown_status")
        .when((status == "ok") & (F.trim(text) == ""), "ok_without_text")
        .when((status == "empty") & (F.trim(text) != ""), "empty_with_text")
        .when((status == "unavailable") & (text != ""), "unavailable_with_text")
        .otherwise("consistent")
    )
