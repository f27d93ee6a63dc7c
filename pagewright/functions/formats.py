"""Durations, sizes, percentages and log lines as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def _text(x: Column) -> Column:
    return x.cast("string")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """``floor(x + 0.5)`` rounding, which differs from ``round`` below zero."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale if digits else _whole(x + 0.5)


def percent(done: Column, total: Column) -> Column:
    """Whole percentage, 0 where the total is 0."""
    return F.when(total > 0, round_half_up(done.cast("double") / total * 100)).otherwise(F.lit(0).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 by the clock shown in ``ts`` (both timestamp types)."""
    return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))


def duration_words(ms: Column) -> Column:
    """``1h 2m`` / ``1m 5s`` / ``5s``."""
    seconds = _whole(ms / 1000)
    minutes, hours = _whole(seconds / 60), _whole(seconds / 3600)
    return (F.when(hours > 0, F.concat(_text(hours), F.lit("h "), _text(minutes % 60), F.lit("m")))
            .when(minutes > 0, F.concat(_text(minutes), F.lit("m "), _text(seconds % 60), F.lit("s")))
            .otherwise(F.concat(_text(seconds), F.lit("s"))))


def duration_clock(ms: Column) -> Column:
    """``1:02:05`` / ``1:05`` / ``5s`` / ``500ms``."""
    seconds = _whole(ms / 1000)
    minutes, hours = _whole(seconds / 60), _whole(seconds / 3600)

    def two(x: Column) -> Column:
        return F.lpad(_text(x), 2, "0")

    return (F.when(ms < 1000, F.concat(_text(round_half_up(ms)), F.lit("ms")))
            .when(hours > 0, F.concat(_text(hours), F.lit(":"), two(minutes % 60), F.lit(":"), two(seconds % 60)))
            .when(minutes > 0, F.concat(_text(minutes), F.lit(":"), two(seconds % 60)))
            .otherwise(F.concat(_text(seconds), F.lit("s"))))


def timer(seconds: Column) -> Column:
    """``m:ss``."""
    return F.concat(_text(_whole(seconds / 60)), F.lit(":"), F.lpad(_text(seconds % 60), 2, "0"))


def age(ms: Column) -> Column:
    """Relative age of a saved state."""
    minutes = _whole(ms / 60000)
    hours = _whole(minutes / 60)
    return (F.when(hours > 0, F.concat(F.lit("há "), _text(hours), F.lit("h"), _text(minutes % 60), F.lit("min")))
            .when(minutes > 0, F.concat(F.lit("há "), _text(minutes), F.lit(" minutos")))
            .otherwise(F.lit(P.AGE_RECENT)))


def size_text(size: Column) -> Column:
    """Two decimals, in MB above one MiB and in KB otherwise."""
    mb, kb = size / 1048576, size / 1024
    return (F.when(mb > 1, F.concat(F.format_string("%.2f", mb), F.lit(" MB")))
            .otherwise(F.concat(F.format_string("%.2f", kb), F.lit(" KB"))))


def size_mb(size: Column) -> Column:
    """At most one decimal, without a trailing zero."""
    tenths = round_half_up(size / 1048576 * 10)
    whole, rest = _whole(tenths / 10), tenths % 10
    return F.concat(_text(whole), F.when(rest > 0, F.concat(F.lit("."), _text(rest))).otherwise(F.lit("")),
                    F.lit(" MB"))


def thousands(words: Column) -> Column:
    return F.concat(_text(round_half_up(words / 1000)), F.lit("K"))


def expected_minutes(pages: Column) -> Column:
    """Rule of thumb of 20 pages a minute."""
    return F.ceil(pages / 20).cast("long")


def log_line(ts: Column, level: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), F.upper(level), F.lit(": "), message)


def step_label(name: Column) -> Column:
    """Step name before its progress suffix."""
    return F.split_part(name, F.lit(" - "), F.lit(1))


def with_progress(name: Column, progress: Column) -> Column:
    return F.concat(step_label(name), F.lit(" - "), progress)


def final_name(name: Column) -> Column:
    return F.concat(base_name(name), F.lit("_final.txt"))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf\z", "")


def filtered_name(name: Column, excluded_annexes: Column, excluded_sections: Column) -> Column:
    """File name that states what was left out; the counts are 0 where nothing was."""
    parts = F.concat_ws(
        "_and_",
        F.when(excluded_annexes > 0, F.concat(F.lit("without_"), _text(excluded_annexes), F.lit("_annexes"))),
        F.when(excluded_sections > 0, F.concat(F.lit("without_"), _text(excluded_sections), F.lit("_sections"))))
    return F.concat(F.coalesce(base_name(name), F.lit("document")), F.lit("_"),
                    F.when(parts == "", F.lit("complete")).otherwise(parts), F.lit(".txt"))
