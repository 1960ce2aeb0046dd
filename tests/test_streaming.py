"""Streams run to completion on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking
from corvane.sources.snapshots import SnapshotTable
from corvane.streaming import ingest

NOTES = "file string, note string, folder string, mtime double, content string"


def write(spark, rows, path):
    spark.createDataFrame(rows, NOTES).coalesce(1).write.mode("append").parquet(path)


def test_incremental_equals_rebuild(spark, tmp_path):
    text = lambda k: f"# Heading {k}\nsome text that is long enough {k}\n# Another {k}\nand more text that is long enough"
    source = str(tmp_path / "in")
    table, hashes = SnapshotTable(spark, str(tmp_path / "t")), SnapshotTable(spark, str(tmp_path / "h"))
    run = lambda: ingest.ingest(ingest.note_stream(spark, source, files_per_batch=1), table, hashes, chunking.note_chunks, str(tmp_path / "cp")).awaitTermination()
    write(spark, [("a.md", "a", "", 1.0, text(1)), ("b.md", "b", "", 1.0, text(2))], source)
    run()
    version = table.current()
    write(spark, [("a.md", "a", "", 2.0, text(1)), ("b.md", "b", "", 2.0, text(2))], source)  # nothing changed
    run()
    assert table.current() == version
    write(spark, [("a.md", "a", "", 3.0, text(9)), ("b.md", "b", "", 3.0, "x"), ("c.md", "c", "", 3.0, text(3))], source)
    run()
    now = spark.createDataFrame([("a.md", "a", "", 3.0, text(9)), ("b.md", "b", "", 3.0, "x"), ("c.md", "c", "", 3.0, text(3))], NOTES)
    key = lambda df: sorted((r.id, r.text, r.section) for r in df.collect())
    assert key(table.read()) == key(chunking.note_chunks(now))


def test_incomplete_files_come_again(spark, tmp_path):
    source = str(tmp_path / "in")
    table, hashes, retry = (SnapshotTable(spark, str(tmp_path / n)) for n in "thr")
    chunks = lambda df: df.select("file", "content")
    failing = {"b.md"}
    complete = lambda d: d.where(~F.col("file").isin(*failing)) if failing else d
    run = lambda: ingest.ingest(ingest.note_stream(spark, source), table, hashes, chunks, str(tmp_path / "cp"), complete=complete, retry=retry).awaitTermination()
    state = lambda: ({r.file: r.content for r in table.read().collect()}, {r.file for r in hashes.read().collect()}, {r.file: r.content for r in retry.read().collect()})
    write(spark, [("a.md", "a", "", 1.0, "one"), ("b.md", "b", "", 1.0, "two")], source)
    run()
    assert state() == ({"a.md": "one"}, {"a.md"}, {"b.md": "two"})
    failing = {"a.md"}
    write(spark, [("a.md", "a", "", 2.0, "one again"), ("c.md", "c", "", 2.0, "three")], source)
    run()  # what failed is part of this batch; what fails now keeps its old chunks
    assert state() == ({"a.md": "one", "b.md": "two", "c.md": "three"}, {"a.md", "b.md", "c.md"}, {"a.md": "one again"})
    failing = set()
    ingest.retry_failed(table, hashes, chunks, retry, complete=complete)
    assert state() == ({"a.md": "one again", "b.md": "two", "c.md": "three"}, {"a.md", "b.md", "c.md"}, {})
    parts = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "file string, ok boolean")
    assert [r.file for r in ingest.complete_files(parts).collect()] == ["b"]


def test_error_lifecycle(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = [[("a", day(0), False), ("b", day(0), False), ("c", day(0), True)], [("a", day(1), False), ("b", day(1), True)], [("a", day(2), False)], [("z", day(60), False)], [("z", day(61), False)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, ts timestamp, ok boolean"
    seen = {}
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 hour")
        q = ingest.error_lifecycle(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
        q.awaitTermination()
    for r in spark.read.parquet(out).orderBy("last_seen").collect():
        seen.setdefault(r.id, []).append(r.status)
    assert seen["a"] == ["pending", "pending", "permanent"] and set(seen["b"]) == {"pending", "fixed", "archived"} and "c" not in seen


def test_error_merge(spark):
    t = dt.datetime(2024, 3, 1)
    old = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", "pending", old, old, 2), ("b", "pending", old, old, 1), ("c", "fixed", old, old, 1), ("d", "permanent", old, old, 3)], ingest.ERROR_SCHEMA)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.id: (r.status, r.retry_count) for r in ingest.merge_errors(log, ids("a", "new"), ids("b"), now=t).collect()}
    assert got == {"a": ("permanent", 3), "b": ("fixed", 1), "c": ("archived", 1), "d": ("permanent", 3), "new": ("pending", 1)}


def test_watchdog(spark):
    rows = [("slow", i, 1.0 if i < 10 else 31.0) for i in range(17)] + [("fine", i, 1.0 if i != 12 else 99.0) for i in range(20)] + [("young", i, 50.0) for i in range(5)]
    got = ingest.watchdog(spark.createDataFrame(rows, "job string, batch int, seconds double"))
    assert [(r.job, r.first_bad) for r in got.collect()] == [("slow", 10)]


def test_debounce(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, at(0), "a"), (1, at(300), "ab"), (1, at(700), "abc"), (1, at(2000), "x"), (2, at(0), "q")]
    got = ingest.debounce(spark.createDataFrame(rows, "user_id long, ts timestamp, typed string")).orderBy("user_id", "burst_start").collect()
    assert [(r.user_id, r.n_events, r.typed) for r in got] == [(1, 3, "abc"), (1, 1, "x"), (2, 1, "q")]


@pytest.mark.parametrize(("kinds", "state"), [(["submit"], "running"), (["submit", "done"], "done"), (["submit", "done", "cancel"], "cancelled"), (["error"], "failed")])
def test_request_states(spark, kinds, state):
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "request_id string, ts int, kind string")
    assert ingest.request_states(df).select(F.col("state")).first()[0] == state
