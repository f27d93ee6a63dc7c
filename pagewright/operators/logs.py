"""Log tables: intake, filters, counts, severity and processing phase.

A log table has ``id, ts, level, source, message`` and is ordered by ``ts, id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.formats import epoch_ms, log_line
from ..functions.text import has_any
from .slices import ROWS, cuts, numbered, overlapped, sliced

#: Retention of the log, of the errors and of a client's view.
KEEP_LOGS, KEEP_ERRORS, KEEP_CLIENT = 1000, 100, 200
#: Levels that a status names, also where no entry has them.
LEVELS = ["info", "warn", "error", "debug"]


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("id")]


def accept_logs(posted: DataFrame) -> DataFrame:
    """Posted entries with both level and message; the source defaults to the front end."""
    return (posted.filter((F.col("level") != "") & (F.col("message") != ""))
            .withColumn("source", F.coalesce("source", F.lit("frontend"))))


def accept_errors(posted: DataFrame) -> DataFrame:
    """Posted errors with a message, which is prefixed by its source."""
    source = F.coalesce("source", F.lit("frontend"))
    return (posted.filter(F.col("error") != "")
            .withColumn("error", F.concat(F.lit("["), source, F.lit("] "), F.col("error"))).drop("source"))


def without_noise(logs: DataFrame) -> DataFrame:
    """Entries that are not noise; one without source or message stays."""
    message = F.col("message")
    return logs.filter(~F.col("source").eqNullSafe(P.NOISE_SOURCE) & ~message.eqNullSafe(P.NOISE_MESSAGE)
                       & ~F.coalesce(F.startswith(message, F.lit(P.NOISE_PREFIX)), F.lit(False)))


def filter_logs(logs: DataFrame, level: str | None = None, source: str | None = None) -> DataFrame:
    """Relevant entries; filters on plain columns reach the scan."""
    kept = without_noise(logs)
    if level:
        kept = kept.filter(F.col("level") == level)
    if source:
        kept = kept.filter(F.col("source") == source)
    return kept


def retain_latest(entries: DataFrame, n: int = KEEP_LOGS) -> DataFrame:
    """The newest ``n`` entries; a per-partition top-n, not a global sort."""
    return entries.orderBy(*newest_first()).limit(n)


def log_query(logs: DataFrame, level: str | None = None, source: str | None = None, limit: int = 50) -> DataFrame:
    """Newest matching entries, with the formatted line of each."""
    return retain_latest(filter_logs(logs, level, source), limit).withColumn(
        "line", log_line(F.col("ts"), F.col("level"), F.col("message")))


def log_total(logs: DataFrame, level: str | None = None, source: str | None = None) -> DataFrame:
    """Matching entries before any limit."""
    return filter_logs(logs, level, source).agg(F.count(F.lit(1)).alias("total"))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("total"))


def is_recoverable(message: Column) -> Column:
    return F.rlike(message, F.lit(P.RECOVERABLE_ERROR))


def is_retriable(message: Column) -> Column:
    return has_any(message, P.RETRIABLE_WORDS)


def error_entries(logs: DataFrame) -> DataFrame:
    """Error-level log entries as posted errors."""
    posted = logs.filter(F.col("level") == "error").select("id", "ts", F.col("message").alias("error"), "source")
    return accept_errors(posted)


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_recoverable(F.col("error"))).alias("recoverable"),
        F.count_if(is_retriable(F.col("error"))).alias("retriable"))


def recent_errors(errors: DataFrame, n: int = 20) -> DataFrame:
    return errors.orderBy(*newest_first()).limit(n)


def status_summary(logs: DataFrame, errors: DataFrame, n: int = 5) -> DataFrame:
    """Status as rows (section, name, total, id): all entries, entries per level, all errors, the newest ``n`` errors.

    Levels without entries count 0. One pass over the logs; NULL levels count only in the whole.
    """
    def row(section: str, name: str, total: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), total.alias("total"))

    counts = logs.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("level") == name).alias(name) for name in LEVELS])
    found = counts.select(F.inline(F.array(
        row("logs", "total", F.col("all")), *[row("level", name, F.col(name)) for name in LEVELS])))
    failed = errors.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(row("errors", "total", F.col("n")))))
    recent = recent_errors(errors, n).select(
        F.lit("recent").alias("section"), F.col("error").alias("name"), F.lit(None).cast("long").alias("total"), "id")
    return found.unionByName(failed).withColumn("id", F.lit(None).cast("long")).unionByName(recent)


def severity(message: Column) -> Column:
    chain = F
    for name, words in P.SEVERITY_WORDS:
        chain = chain.when(has_any(message, words), name)
    return chain.otherwise("plain")


def severity_counts(lines: DataFrame) -> DataFrame:
    """Formatted lines by severity, with the two kinds of suspicious lines."""
    line = F.col("line")
    return lines.groupBy(severity(line).alias("severity")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has_any(line, P.OCR_ISSUE_WORDS)).alias("ocr_issues"),
        F.count_if(has_any(line, P.DETECTION_WORDS)).alias("detection_problems"))


def phase_of(message: Column, words: dict[int, list[str]] = P.PHASE_WORDS) -> Column:
    """Highest phase a message names, else 0."""
    chain = F
    for phase, names in words.items():
        chain = chain.when(has_any(message, names), phase)
    return chain.otherwise(0)


def phase_states(phase: Column) -> list[Column]:
    """Status of phases 1-4 as seen from the current one."""
    return [F.when(phase > p, "completed").when(phase == p, "active").otherwise("pending").alias(f"phase_{p}")
            for p in (1, 2, 3, 4)]


def overridden(phase: Column, is_formatting: Column, is_processing: Column) -> Column:
    """What the state of the run says over its messages: formatting is phase 4, and a running one at least in phase 1.

    Only phases 1 to 4 are shown; NULL states say nothing.
    """
    return (F.when(F.coalesce(is_formatting, F.lit(False)), 4)
            .when(F.coalesce(is_processing, F.lit(False)), F.greatest(phase, F.lit(1))).otherwise(phase))


def current_phase(logs: DataFrame, n: int = 10, words: dict[int, list[str]] = P.PHASE_WORDS, is_formatting: bool = False,
                  is_processing: bool = False) -> DataFrame:
    """Phase now: the highest named in the newest ``n`` messages, unless the state of the run says more."""
    named = F.coalesce(F.max(phase_of(F.col("message"), words)), F.lit(0))
    return retain_latest(logs, n).agg(overridden(named, F.lit(is_formatting), F.lit(is_processing)).alias("phase"))


def phase_window(logs: DataFrame, n: int = 10, rows: int = ROWS, block: int = 10_000, is_formatting: Column | None = None,
                 is_processing: Column | None = None) -> DataFrame:
    """Phase after every log entry, over the ``n`` messages up to it, unless the state of the run then says more.

    Entries are numbered through time slices and then cut into blocks that carry copies of the
    ``n - 1`` entries before them, so no task holds the whole log, however dense it is.
    """
    none = F.lit(False)
    at = epoch_ms(F.col("ts"))
    narrow = logs.select("id", "ts", phase_of(F.col("message")).alias("_named"),
                         (none if is_formatting is None else is_formatting).alias("_formatting"),
                         (none if is_processing is None else is_processing).alias("_processing"))
    parted = sliced(narrow, at, cuts(logs, at, rows))
    copied = overlapped(numbered(parted, [], ["ts", "id"], "_no"), "_no", block, n - 1)
    frame = Window.partitionBy("_block").orderBy("_no").rowsBetween(1 - n, 0)
    phase = F.col("phase")
    return (copied.withColumn("phase", F.max("_named").over(frame)).filter(~F.col("_copy"))
            .withColumn("phase", overridden(phase, F.col("_formatting"), F.col("_processing")))
            .select("id", phase, *phase_states(phase)))
