"""Markdown corpora as tables (SRC-1..5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIP_FOLDERS = ("node_modules", "__pycache__", "templates")
CHAPTER = r"(?i)^(?:(?:vol(?:ume)?|sect?(?:ion)?|part|pages?|pp?|ch(?:apter)?)[ _.-]?)?\d+[ _.-]"
NEVER_CONTENT = ("index.md",)


def in_skipped_folder(rel: Column, skip: tuple[str, ...] = SKIP_FOLDERS) -> Column:
    """SRC-1: whether a part of the path is hidden or listed."""
    return F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | p.isin(*skip))


def scan(spark: SparkSession, root: str, *, skip: tuple[str, ...] = SKIP_FOLDERS, lossy: bool = False) -> DataFrame:
    """SRC-1..4: (file, note, folder, mtime, content, ok) of every Markdown file below root.

    Undecodable files have ok false and null content, or replacement characters if lossy.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
    prefix = "^.*?" + "\\Q" + base.split("://")[-1].lstrip("/") + "\\E/+"
    rel = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), prefix, "")
    text = F.decode("content", "UTF-8") if lossy else F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    if lossy:
        text = F.make_valid_utf8(F.col("content").cast("string"))
    parts = F.split(rel, "/")
    return raw.select(
        rel.alias("file"), F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("note"),
        F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("").alias("folder"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"), text.alias("content"),
    ).where(~in_skipped_folder(F.col("file"), skip)).withColumn("ok", F.col("content").isNotNull())


def select_files(files: DataFrame, *, skip: tuple[str, ...] = ("INDEX.md",), whole: tuple[str, ...] = ("full_text.md",), chapter: str = CHAPTER) -> DataFrame:
    """SRC-5: files (path) to index, with guard_kept; rules by directory.

    Index pages go always; other names on the skip list go unless the directory would then be
    empty; a whole-book file goes if a file named like a chapter stays beside it.
    """
    low = lambda names: [n.lower() for n in names]
    hard = [n for n in low(skip) if n in NEVER_CONTENT]
    soft = [n for n in low(skip) if n not in NEVER_CONTENT]
    name = F.element_at(F.split("path", "/"), -1)
    f = (
        files.where(~F.exists(F.split("path", "/"), lambda p: p == "__pycache__"))
        .withColumn("dir__", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("name__", F.lower(name)).where(~F.col("name__").isin(hard))
        .withColumn("shape__", name.rlike(chapter))
    )
    w = Window.partitionBy("dir__")
    is_soft, is_whole = F.col("name__").isin(soft), F.col("name__").isin(low(whole))
    f = f.withColumn("guard_kept", F.min(F.when(is_soft, 1).otherwise(0)).over(w) == 1)
    stays = ~is_soft | F.col("guard_kept")
    chapters = F.max(F.when(stays & ~is_whole & F.col("shape__"), 1).otherwise(0)).over(w) == 1
    return f.withColumn("whole_skipped", stays & is_whole & chapters).withColumn("kept", stays & ~F.col("whole_skipped")).drop("dir__", "name__", "shape__")
