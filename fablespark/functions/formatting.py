"""Formatting of metrics and reading of short answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """Days, hours and minutes as far as needed; seconds are left out when there are none beside larger units."""
    s = F.floor(seconds).cast("long")
    day, hour, minute, second = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    parts = F.array(
        F.when(day > 0, F.concat(day.cast("string"), F.lit("d"))),
        F.when((day > 0) | (hour > 0), F.concat(hour.cast("string"), F.lit("h"))),
        F.when((day > 0) | (hour > 0) | (minute > 0), F.concat(minute.cast("string"), F.lit("m"))),
        F.when((second > 0) | (s < 60), F.concat(second.cast("string"), F.lit("s"))),
    )
    return F.array_join(parts, " ")


def metric(name: Column, value: Column, percent: Column | None = None) -> Column:
    """A metric for a report: by its name a duration, an average, a whole number, or a number with its percentage."""
    shown = (
        F.when(value.isNull(), "—")
        .when(name.endswith("_time"), duration(value))
        .when(name.startswith("avg_"), F.format_string("%.3f", value))
        .when(name.endswith("_tokens") | name.startswith("max_"), F.floor(value).cast("long").cast("string"))
        .otherwise(F.format_string("%.3f", value))
    )
    if percent is None:
        return shown
    return F.when(value.isNotNull() & percent.isNotNull(), F.format_string("%d (%.1f%%)", value.cast("long"), percent)).otherwise(shown)


def yes_or_no(answer: Column) -> Column:
    """True for an answer with YES or SAME, else false for one with NO or DIFFERENT, else null."""
    up = F.upper(answer)
    return F.when(up.contains("YES") | up.contains("SAME"), True).when(up.contains("NO") | up.contains("DIFFERENT"), False)


def first_title(h1: Column, h2: Column, h3: Column, second_paragraph: Column) -> Column:
    """The first heading there is, the second paragraph, or a fixed title."""
    return F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in (h1, h2, h3, second_paragraph)], F.lit("Untitled Chapter"))
