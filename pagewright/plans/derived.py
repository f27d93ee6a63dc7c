"""Inputs derived from the driver tables (definitions in FIXTURES.md section 2).

A document is one row, so its lines are rewritten in place: no derived text costs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import epoch_ms
from ..functions.text import lines
from ..session import spread, table

LEGAL_TAIL = "\nANNEX A\nDefinitions\nDEFINITIONS AND TERMS\nend"


def _s(x: Column) -> Column:
    return x.cast("string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def legal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")

    def rewrite(line: Column, ln: Column) -> Column:
        six = ln % 6
        return (
            F.when((ln == 0) & (doc % 5 == 0),
                   F.concat(F.lit("PREAMBLE\nMembers,\nNoting "), line, F.lit("\n"), line,
                            F.lit("\nHereby agree as follows:")))
            .when(six == 0, F.concat(F.lit("CHAPTER "), _s(F.floor(ln / 6).cast("int") + 1), F.lit("\n"), line))
            .when(six == 1, F.concat(F.lit("Article "), _s(ln), F.lit(": Scope\n"), line))
            .when(six == 2, F.concat(F.lit("1.\n"), line))
            .when(six == 3, F.concat(F.lit("(a)\n"), line))
            .when((six == 4) & (doc % 2 == 0), F.concat(F.lit("6. (b) "), line))
            .when(six == 4, F.concat(F.lit("7. "), line))
            .when(doc % 3 == 0, F.concat(_s(ln), F.lit(' "'), line, F.lit('"')))
            .otherwise(F.concat(_s(ln), F.lit("\n"), line)))

    text = F.array_join(F.transform(lines(F.col("text")), rewrite), "\n")
    return documents(spark, sf_dir).select("doc_id", F.concat(text, F.lit(LEGAL_TAIL)).alias("text"))


def footnote_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def reference(line: Column, ln: Column) -> Column:
        mark = F.concat(line, F.lit("{{footnotenumber"), _s(100 + ln), F.lit("}}"))
        return F.when(ln % 2 == 0, mark).otherwise(line)

    def definition(line: Column, ln: Column) -> Column:
        note = F.concat(F.lit("{{footnote"), _s(100 + ln), F.lit("}} "), _s(ln), F.lit(" note {{-footnote"),
                        _s(100 + ln), F.lit("}}"))
        return F.when(ln % 4 == 0, note).otherwise(F.lit(""))

    parts = lines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.concat(
        F.array_join(F.transform(parts, reference), "\n"), F.lit("\n"),
        F.array_join(F.transform(parts, definition), "")).alias("text"))


def tagged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tag(line: Column, ln: Column) -> Column:
        six = ln % 6
        return (F.when(six == 0, F.concat(F.lit("<h>"), line, F.lit("</h>")))
                .when(six.isin(2, 3), F.concat(F.lit("<li>"), line, F.lit("</li>")))
                .when(six == 4, F.concat(F.lit("<p>"), line, F.lit("<fn>["), _s(ln), F.lit("] note "), _s(ln),
                                         F.lit("</fn></p>")))
                .otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>"))))

    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(lines(F.col("text")), tag), "\n").alias("text"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    return documents(spark, sf_dir).filter(doc % 2 == 0).select(
        "doc_id", F.lit(1).alias("page_no"),
        F.when(doc % 3 == 0, F.concat(text, F.lit("\n---CHANGES MADE---\nspacing fixed\n---END CHANGES---")))
        .when(doc % 3 == 1, F.concat(text, F.lit("\n---NO CHANGES NEEDED---"))).otherwise(text).alias("reply"))


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag replies: valid JSON, fenced JSON and broken ones."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 3 == 0, F.lit("```json\n[1]\n```")).when(doc % 3 == 1, F.lit("[]"))
        .otherwise(F.lit("page one")).alias("reply"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a single page."""
    return documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document and its turns as pages 1..N."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")


def footnote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten consecutive footnote documents as the pages of one document."""
    return footnote_docs(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("doc_id"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("page_no"), "text")


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with their numbered heading tags reduced to ``h``."""
    return spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<(/?)h[1-6]>", "<$1h>").alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def as_logs(events: DataFrame) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    return events.select(
        event.alias("id"), "ts",
        F.when(kind == "error", "error").when(kind == "signup", "warn").when(kind == "click", "debug")
        .otherwise("info").alias("level"),
        F.when(event % 11 == 0, "debug-api").when(kind == "view", "middleware").otherwise("server").alias("source"),
        F.when(event % 13 == 0, "GET /api/debug/logs").when(event % 17 == 0, "Logs requested")
        .when((kind == "error") & (event % 2 == 0), "network timeout").when(kind == "error", "invalid format")
        .when(event % 19 == 0, F.concat(F.lit("Phase "), _s(event % 4 + 1), F.lit(" started")))
        .otherwise(F.concat(F.lit("event "), kind)).alias("message"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(events(spark, sf_dir))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), "event_id", "ts",
        F.concat(F.lit("phase"), _s(F.col("event_id") % 4 + 1)).alias("step_id"),
        F.when(F.col("event_type") == "signup", "stop").otherwise("start").alias("action"))


def as_task_steps(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("task_id"), "event_id", "ts", F.col("event_type").alias("step"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .otherwise("started").alias("status"))


def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_steps(events(spark, sf_dir))


def session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, done = F.col("user_id"), F.col("event_type") == "purchase"
    return spread(events(spark, sf_dir)).select(
        user.alias("file_id"), F.concat(F.lit("file"), _s(user), F.lit(".pdf")).alias("name"),
        (user * 1000).alias("size"), user.alias("last_modified"), "ts", "event_id",
        F.lit(100).alias("total_pages"), (F.col("event_id") % 101).alias("done_pages"),
        (~done).alias("is_processing"), done.alias("is_completed"))


def as_clicks(events: DataFrame) -> DataFrame:
    """Every event as a click, in time compressed so that bursts below one second occur."""
    return events.select("user_id", "event_id", F.floor(epoch_ms(F.col("ts")) / 20000).cast("long").alias("at_ms"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_clicks(events(spark, sf_dir))


def as_feed_steps(events: DataFrame) -> DataFrame:
    """Task steps with a message, timed in milliseconds."""
    return as_task_steps(events).select("task_id", "event_id", epoch_ms(F.col("ts")).alias("at_ms"), "status",
                                        F.concat(F.lit("step "), F.col("step")).alias("message"))


def as_subscriptions(events: DataFrame) -> DataFrame:
    """Every fiftieth event as a subscription, every ninth of these to a task that does not exist."""
    unknown = F.when(F.col("event_id") % 450 == 0, 1_000_000_000).otherwise(0)
    return events.filter(F.col("event_id") % 50 == 0).select(
        F.col("event_id").alias("sub_id"), (F.col("user_id") + unknown).cast("long").alias("task_id"),
        epoch_ms(F.col("ts")).alias("at_ms"))
