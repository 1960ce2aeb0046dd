"""Building and refreshing the tables of a corpus (SRC → TXT → KNN-6 → SNK), in full or by change."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import changes, chunking, entities, graph, vector
from corvane.settings import Settings
from corvane.sources import markdown
from corvane.sources.snapshots import SnapshotTable, signature
from corvane.streaming.ingest import ERROR_SCHEMA, merge_errors


class Corpus:
    """The snapshot tables of one corpus: notes, chunks, parents, children, edges, relations, entities, bridges, hashes."""

    def __init__(self, spark: SparkSession, settings: Settings, embedder: vector.Embedder | None = None) -> None:
        self.spark, self.settings = spark, settings
        self.embedder = embedder or vector.hashing_embedder(settings.embedding_dim)
        self.signature = signature(dim=settings.embedding_dim, parent=chunking.PARENT_MAX, child=chunking.CHILD, overlap=chunking.OVERLAP, least=chunking.LEAST)

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.settings.tables_dir}/{name}")

    def embed(self, text: str) -> list[float]:
        import pandas as pd

        return list(self.embedder(pd.Series([text])).iloc[0])

    def _vectors(self, rows: DataFrame) -> DataFrame:
        """Rows with vectors; what could not be embedded goes, and its file is not recorded as done."""
        return vector.embed_batches(rows, self.embedder, tries=4)

    def index_notes(self, *, incremental: bool = False) -> dict[str, int]:
        """STR-1, SNK-2, SNK-5: full or by content hash; counts of the run."""
        found = markdown.scan(self.spark, self.settings.notes_dir, skip=tuple(self.settings.skip_folders))
        now = found.where("ok").withColumn("hash", changes.content_hash(F.col("content")))
        chunks, hashes, notes = self.table("chunks"), self.table("hashes"), self.table("notes")
        todo = now
        if incremental and hashes.exists():
            state = changes.detect(now, hashes.read()).where(F.col("state").isin("new", "modified"))
            todo = now.join(state.select("file"), "file", "left_semi")
        # one evaluation of the embedder: the result is written before anything is read from it
        parts = self.table("staged_chunks")
        parts.overwrite(self._vectors(chunking.note_chunks(todo)))
        made = parts.read()
        failed = made.where("vector IS NULL").select("file").distinct()
        done = todo.select("file", "hash").join(failed, "file", "left_anti")
        good = made.where("vector IS NOT NULL")
        counts = {"files": now.count(), "processed": todo.count(), "errors": found.where("NOT ok").count() + failed.count(), "chunks": good.count()}
        hash_rows, note_rows = self.table("staged_hashes"), now.select("file", "note", "folder", "mtime", "content")
        hash_rows.overwrite(done)
        if incremental and chunks.exists():
            chunks.upsert(good, touched=todo.select("file"))
            hashes.upsert(hash_rows.read(), touched=todo.select("file"))
            chunks.prune(now.select("file"))
            hashes.prune(now.select("file"))
        else:
            chunks.overwrite(good)
            hashes.overwrite(hash_rows.read())
        notes.overwrite(note_rows)
        for t in (chunks, hashes, notes, parts, hash_rows):
            t.purge()
        return counts

    def reindex_note(self, file: str) -> dict[str, int]:
        """STR-2: one note anew, or out of the tables if its file is gone."""
        found = markdown.scan(self.spark, self.settings.notes_dir, skip=tuple(self.settings.skip_folders)).where((F.col("file") == file) & F.col("ok"))
        now, made = found.withColumn("hash", changes.content_hash(F.col("content"))), self.table("staged_chunks")
        key = self.spark.createDataFrame([(file,)], "file string")
        made.overwrite(self._vectors(chunking.note_chunks(now)))
        bad, good = made.read().where("vector IS NULL").count(), made.read().where("vector IS NOT NULL")
        if bad:
            return {"chunks": 0, "errors": bad}
        self.table("chunks").upsert(good, touched=key)
        self.table("notes").upsert(now.select("file", "note", "folder", "mtime", "content"), touched=key)
        self.table("hashes").upsert(now.select("file", "hash"), touched=key)
        return {"chunks": good.count(), "errors": 0}

    def index_longform(self, *, book: str | None = None, retry: bool = False, reset: bool = False, now: float | None = None) -> dict[str, int]:
        """TXT-6..20: parents and children of all books, of one, or (retry) of the files whose children failed before.

        Children that could not be embedded go to the error log (STR-5); what succeeds is marked there as fixed. `reset` empties the log.
        """
        parents, children, errors = self.table("parents"), self.table("children"), self.table("errors")
        if reset or not errors.exists():
            errors.overwrite(self.spark.createDataFrame([], ERROR_SCHEMA + ", file string"))
        files = markdown.scan(self.spark, self.settings.longform_dir, lossy=True)
        kept = markdown.select_files(files.select(F.col("file").alias("path"))).where("kept").select(F.col("path").alias("file"))
        files = files.join(kept, "file", "left_semi")
        if book:
            files = files.where(F.col("file").startswith(f"{book}/"))
        if retry:
            files = files.join(errors.read().where("status IN ('pending', 'permanent')").select("file").distinct(), "file", "left_semi")
        fresh = chunking.longform_parents(files).withColumn("indexing_signature", F.lit(self.signature))
        # one evaluation of the embedder: the result is written before anything is read from it
        made = self.table("staged_children")
        made.overwrite(self._vectors(chunking.longform_children(fresh.drop("indexing_signature"))))
        kids, failed = made.read().where("vector IS NOT NULL"), made.read().where("vector IS NULL").select("id", "file")
        if (book or retry) and parents.exists():
            touched = files.select("file")
            parents.upsert(fresh, touched=touched)
            children.upsert(kids, touched=touched)
        else:
            parents.overwrite(fresh)
            children.overwrite(kids)
        at = dt.datetime.fromtimestamp(now if now is not None else time.time(), dt.timezone.utc)
        log = errors.read()
        known = log.select("id", "file").unionByName(failed).groupBy("id").agg(F.min("file").alias("file"))
        errors.overwrite(merge_errors(log.drop("file"), failed, kids.select("id"), now=at).join(known, "id"))
        parents.mark_ready(self.signature)
        n_failed = failed.count()
        for t in (parents, children, errors, made):
            t.purge()
        return {"parents": parents.count(), "children": children.count(), "failed": n_failed}

    def build_graph(self) -> dict[str, int]:
        """GRF-1, AGG-5."""
        notes = self.table("notes").read()
        edges = self.table("edges")
        edges.overwrite(graph.symmetric(graph.note_links(notes)))
        edges.purge()
        return graph.totals(notes, edges.read()).first().asDict()

    def resolve(self) -> int:
        """ENT-3, SET-6, ENT-7: entities of relations under recognised ones, and the bridges between notes."""
        relations, ents, out = self.table("relations"), self.table("entities"), self.table("bridges")
        rel = relations.read() if relations.exists() else self.spark.createDataFrame([], "`from` string, `to` string, type string, source_note string")
        mine = entities.entities_of_relations(rel)
        ents.overwrite(entities.merge_absent(ents.read(), mine) if ents.exists() else mine)
        out.overwrite(entities.bridges(ents.read(), rel))
        return out.count()
