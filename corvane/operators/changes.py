"""Change detection and snapshot merges (JOIN-8, JOIN-9, SNK-3..5, SET-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """SCL-6."""
    return F.sha2(c, 256)


def detect(current: DataFrame, known: DataFrame, *, key: str = "file", value: str = "hash") -> DataFrame:
    """JOIN-8: (file, state) with state new, modified, unchanged or gone."""
    a, b = current.select(key, F.col(value).alias("now__")), known.select(key, F.col(value).alias("was__"))
    state = F.when(F.col("was__").isNull(), "new").when(F.col("now__").isNull(), "gone").when(F.col("now__") == F.col("was__"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, state.alias("state"), F.col("now__").alias(value))


def delete_keys(rows: DataFrame, keys: DataFrame, key: str = "file") -> DataFrame:
    """SNK-3: rows without the keys listed; no predicate text is built, so any name is safe."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, *, key: str = "file", touched: DataFrame | None = None) -> DataFrame:
    """SNK-4: new rows in place of all old rows of their keys; `touched` adds keys that have no new rows any more."""
    keys = new.select(key) if touched is None else new.select(key).union(touched.select(key))
    return delete_keys(old, keys, key).unionByName(new.select(*old.columns))


def prune(rows: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """SNK-5: rows whose file is still there."""
    return rows.join(current.select(key).distinct(), key, "left_semi")


def orphans(rows: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """JOIN-9: indexed files that are gone."""
    return rows.select(key).distinct().join(current.select(key).distinct(), key, "left_anti")


def pending(notes: DataFrame, processed: DataFrame) -> DataFrame:
    """AGG-11: (total, fresh, modified, pending) of notes (note, mtime) against what was processed (note, mtime)."""
    both = notes.join(processed.select("note", F.col("mtime").alias("was__")), "note", "left")
    fresh, changed = F.col("was__").isNull(), F.col("mtime") > F.col("was__")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count_if(fresh).alias("fresh"), F.count_if(changed).alias("modified"), F.count_if(fresh | changed).alias("pending"))


def extraction_order(notes: DataFrame, priority: list[str], n: int) -> DataFrame:
    """TOP-6: notes to process: those to redo, then priority folders, then others; latest first."""
    bucket = F.when(F.col("redo"), 0).when(F.col("folder").isin(priority), 1).otherwise(2)
    return notes.withColumn("bucket", bucket).orderBy("bucket", F.desc("mtime"), "note").limit(n)


def supplementary(files: DataFrame, processed: DataFrame, *, never: tuple[str, ...] = ("MEMORY.md",)) -> DataFrame:
    """ENT-10: (note, file, mtime, folder) of supplementary files (file, mtime) that are new or later than when they were processed (note, mtime)."""
    mine = files.where(~F.element_at(F.split("file", "/"), -1).isin(*never)).withColumn("note", F.concat(F.lit("memory:"), F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.md$", "")))
    both = mine.join(processed.select("note", F.col("mtime").alias("was__")), "note", "left")
    return both.where(F.col("mtime") > F.coalesce("was__", F.lit(0.0))).select("note", "file", "mtime", F.lit("memory").alias("folder"))
