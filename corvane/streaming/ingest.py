"""Incremental ingest as streams (STR-*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import changes
from corvane.sources.snapshots import SnapshotTable


def note_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 50) -> DataFrame:
    """STR-1, STR-3: files of (file, note, folder, mtime, content) rows as they arrive, so many to a batch."""
    schema = "file string, note string, folder string, mtime double, content string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


ToChunks = Callable[[DataFrame], DataFrame]


def merge(batch: DataFrame, table: SnapshotTable, hashes: SnapshotTable, to_chunks: ToChunks, *, complete: ToChunks | None = None, retry: SnapshotTable | None = None) -> None:
    """STR-1, STR-2, STR-4: the batch's new and modified notes replace their old chunks, and only then their hashes are recorded.

    The last row of a file within a batch (by mtime) wins. A file is replaced as a whole or not at all: of the files (file, hash) that
    `complete` leaves out, old chunks and hash stay as they were and the note goes to `retry`, whose notes are
    part of every later batch until they succeed. Rows of a batch that is run twice are unchanged the second time: upserts by key are idempotent.
    """
    waiting = retry is not None and retry.exists()
    if waiting:
        batch = batch.unionByName(retry.read().select(*batch.columns))
    latest = batch.groupBy("file").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "file"]), "mtime").alias("r")).select("file", "r.*")
    now = latest.withColumn("hash", changes.content_hash(F.col("content"))).persist()
    try:
        fresh = now
        if hashes.exists():
            state = changes.detect(now, hashes.read(), value="hash").where(F.col("state").isin("new", "modified")).select("file")
            fresh = now.join(state, "file", "left_semi")
        if waiting:  # what is no longer fresh was written back as it had been
            retry.prune(fresh.select("file"))
        if fresh.isEmpty():
            return
        done = fresh.select("file", "hash")
        if complete:
            done = complete(done)
        table.upsert(to_chunks(fresh.join(done.select("file"), "file", "left_semi").drop("hash")), touched=done.select("file"))
        hashes.upsert(done)
        if retry is not None:
            failed = fresh.join(done.select("file"), "file", "left_anti").drop("hash")
            retry.upsert(failed, touched=fresh.select("file"))
    finally:
        now.unpersist()


def ingest(stream: DataFrame, table: SnapshotTable, hashes: SnapshotTable, to_chunks: ToChunks, checkpoint: str, *, complete: ToChunks | None = None, retry: SnapshotTable | None = None) -> StreamingQuery:
    """STR-1, STR-3: `merge` for each batch of a stream. What failed in the last batch is taken up by the next run, or by `retry_failed`."""
    step = lambda batch, _: merge(batch, table, hashes, to_chunks, complete=complete, retry=retry)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(table: SnapshotTable, hashes: SnapshotTable, to_chunks: ToChunks, retry: SnapshotTable, *, complete: ToChunks | None = None) -> None:
    """STR-4: the notes that failed, once more, without new ones."""
    if retry.exists():
        merge(retry.read().limit(0), table, hashes, to_chunks, complete=complete, retry=retry)


def complete_files(parts: DataFrame) -> DataFrame:
    """STR-4: files (file, ok rows) of which every part succeeded."""
    return parts.groupBy("file").agg(F.bool_and("ok").alias("complete")).where("complete").select("file")


ERROR_SCHEMA = "id string, status string, first_seen timestamp, last_seen timestamp, retry_count int"


def error_lifecycle(events: DataFrame, *, retries: int = 3, archive_days: int = 30) -> DataFrame:
    """STR-5 on a stream of (id, ts, ok): pending, permanent after so many failures, fixed on success, archived when old.

    State is one row per id. A fixed error is archived by event time, when the watermark passes its age.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "status": ["archived"], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "retry_count": [n]})
            return
        status, first, last, n = state.get if state.exists else ("", 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            at = int(pd.Timestamp(ts).value // 1000)
            first, last = first or at, at
            if ok:
                status = "fixed" if status else ""
            else:
                n += 1
                status = "permanent" if n >= retries else "pending"
        if not status:
            return
        state.update((status, first, last, n))
        if status == "fixed":
            state.setTimeoutTimestamp(max(last // 1000 + archive_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "retry_count": [n]})

    return events.groupBy("id").applyInPandasWithState(step, ERROR_SCHEMA, "status string, first long, last long, n int", "update", GroupStateTimeout.EventTimeTimeout)


def merge_errors(log: DataFrame, failures: DataFrame, fixed: DataFrame, *, retries: int = 3, archive_days: int = 30, now) -> DataFrame:
    """STR-5 as a batch merge of the error log (id, status, first_seen, last_seen, retry_count) with this run's failures and successes (id)."""
    f = failures.select("id").distinct().withColumn("failed__", F.lit(True))
    g = fixed.select("id").distinct().withColumn("fixed__", F.lit(True))
    at = F.lit(now).cast("timestamp")
    both = log.join(f, "id", "full_outer").join(g, "id", "left")
    n = F.coalesce("retry_count", F.lit(0)) + F.when(F.col("failed__"), 1).otherwise(0)
    old = (F.col("status") == "fixed") & (F.col("last_seen") < at - F.expr(f"INTERVAL {archive_days} DAYS"))
    status = (
        F.when(F.col("failed__") & (n >= retries), "permanent").when(F.col("failed__"), "pending").when(F.col("fixed__") & (F.col("status") != "archived"), "fixed")
        .when(old, "archived").otherwise(F.col("status"))
    )
    touched = F.coalesce("failed__", F.lit(False)) | F.coalesce("fixed__", F.lit(False))
    return both.select("id", status.alias("status"), F.coalesce("first_seen", at).alias("first_seen"), F.when(touched, at).otherwise(F.col("last_seen")).alias("last_seen"), n.cast("int").alias("retry_count"))


def watchdog(latencies: DataFrame, *, baseline: int = 10, factor: float = 30.0, run: int = 7) -> DataFrame:
    """STR-6: (job, first_bad) of jobs whose batches (job, batch, seconds) ran `run` times in a row above `factor` times the first ones' mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("job").orderBy("batch")
    n = latencies.withColumn("nth", F.row_number().over(w))
    base = n.where(F.col("nth") <= baseline).groupBy("job").agg(F.avg("seconds").alias("base"), F.count(F.lit(1)).alias("seen")).where(F.col("seen") == baseline)
    late = n.where(F.col("nth") > baseline).join(base, "job").withColumn("bad", F.col("seconds") > factor * F.col("base"))
    isl = late.withColumn("island", F.col("nth") - F.row_number().over(Window.partitionBy("job", "bad").orderBy("batch"))).where("bad")
    runs = isl.groupBy("job", "island").agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first_bad")).where(F.col("n") >= run)
    return runs.groupBy("job").agg(F.min("first_bad").alias("first_bad"))


def debounce(events: DataFrame, *, gap: str = "500 milliseconds", delay: str = "10 minutes", keys: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """STR-7: the last event of each burst; bursts end after `gap` of quiet; events later than `delay` are dropped."""
    cols = [c for c in events.columns if c not in keys]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    stream = timed.withWatermark(ts, delay) if events.isStreaming else timed
    got = stream.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n_events"), F.max_by(F.struct(*cols), F.struct(ts, *[c for c in cols if c != ts])).alias("last"))
    return got.select(*keys, F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), "n_events", "last.*")


def request_states(events: DataFrame) -> DataFrame:
    """STR-8: the state of each asynchronous request from its (request_id, ts, kind) events; cancelled is final."""
    kinds = F.collect_set("kind")
    state = F.when(F.array_contains(kinds, "cancel"), "cancelled").when(F.array_contains(kinds, "error"), "failed").when(F.array_contains(kinds, "done"), "done").otherwise("running")
    return events.groupBy("request_id").agg(state.alias("state"), F.min("ts").alias("submitted"), F.max("ts").alias("updated"))
