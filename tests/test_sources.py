"""Readers, writers and streams on files the tests write themselves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright.sources import intake, sinks
from pagewright.sources.versioned import VersionedTable
from pagewright.streaming import feeds
from pagewright.plans import derived


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_inventory(spark, tmp_path, zone):
    """Names, sizes and times of PDFs at any depth, the same in every time zone."""
    os.makedirs(tmp_path / "deep er")
    for name in ("a.pdf", "b.PDF", "c.txt", "deep er/ä b.pdf"):
        (tmp_path / name).write_bytes(b"12345")
        os.utime(tmp_path / name, (1_700_000_000, 1_700_000_000.25))
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = intake.document_inventory(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert sorted((r.name, r.size, r.last_modified // 1000) for r in rows) == [
        ("a.pdf", 5, 1_700_000_000), ("b.PDF", 5, 1_700_000_000), ("ä b.pdf", 5, 1_700_000_000)]
    plan = intake.document_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[-1]


def test_page_texts(spark, tmp_path):
    pages = [{"doc_id": 1, "page_no": 1, "items": [{"str": " a"}, {"str": "b "}]}, {"doc_id": 1, "page_no": 2}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, pages)))
    rows = intake.page_texts(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [r.text for r in rows] == ["a b", ""]


def test_posts_as_stream_equal_batch(spark, tmp_path):
    posts = [{"id": 1, "level": "info", "message": "x"}, {"id": 2, "level": "", "message": "x"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, posts)))
    batch = intake.posted_logs(spark, str(tmp_path)).select("id", "source")
    stream = feeds.run_to_table(intake.posted_logs(spark, str(tmp_path), stream=True).select("id", "source"), "posts")
    assert batch.collect() == stream.collect() == [(1, "frontend")]


def test_text_sink(spark, tmp_path):
    """Many documents a file; two of one name both stay; a broken write leaves the table as it was."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.floor(F.col("id") / 2).cast("string"),
                                   F.lit(".PDF")).alias("name"), F.concat(F.lit("l1\nl2 "), F.col("id").cast("string")).alias("text"))
    table = VersionedTable(spark, str(tmp_path / "out"))
    sinks.write_final_texts(docs.coalesce(2), F.col("name"), table)
    files = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".parquet")]
    assert len(files) == 2
    assert sorted(r.text for r in sinks.read_texts(table, "x3_final.txt").collect()) == ["l1\nl2 6", "l1\nl2 7"]
    broken = docs.withColumn("text", F.when(F.col("doc_id") < 499, F.col("text")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        sinks.write_final_texts(broken, F.col("name"), table)
    assert sinks.read_texts(table).count() == 500


def test_snapshots_append(spark, tmp_path):
    df = spark.createDataFrame([(1, ["l"], [("b", None)])],
                               "id long, debug_logs array<string>, results array<struct<text: string, image_url: string>>")
    table = VersionedTable(spark, str(tmp_path / "s"))
    for _ in range(2):
        sinks.append_snapshots(df, table)
    assert table.read().count() == 2


def test_large_snapshot_is_stored_in_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pagewright.operators.sessions.SIZE_LIMIT", 10)
    logs = [f"line {i}" for i in range(300)]
    df = spark.createDataFrame([(1, logs, [("b", "image")])],
                               "id long, debug_logs array<string>, results array<struct<text: string, image_url: string>>")
    table = VersionedTable(spark, str(tmp_path / "s"))
    sinks.append_snapshots(df, table)
    row = table.read().first()
    assert row.debug_logs == logs and row.results[0].image_url == "image"


def test_status_lines(spark, sf_dir, tmp_path):
    stream = derived.as_task_steps(feeds.read_feed(spark, sf_dir, "events.parquet"))
    sinks.stream_status_lines(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).filter("value <> ''").collect()]
    assert lines and all(json.loads(line.removeprefix("data: "))["status"] for line in lines)
