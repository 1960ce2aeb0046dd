"""Row helpers used by every operator of this folder; staging is the library's."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import reach_workers
from corvane.sources.staging import release, shared_folder, stage

__all__ = ["fit_in_task", "labelled_sample", "pieces", "release", "shared_folder", "spare", "stage", "table"]

CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, budget: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds about `budget` bytes of `column` (one long row is a piece)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, side="right")) - 1)
            hi = min(hi, len(col))
            yield batch.slice(lo, hi - lo)
            lo = hi


def spare(columns: list[str], wanted: str) -> str:
    """A column name close to `wanted` that clashes with none of `columns` (case-insensitively)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


LEAST = 500  # rows of either class that a sample gets even if the class is rare


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, text: str = "text") -> DataFrame:
    """(t, y): at most `bound` labelled texts, by hash order of doc_id (a uniform sample that no file order moves), in one partition.

    If a class has fewer than LEAST rows in it, its next ones in that order fill up to as many.
    Rows with a null id, label or text are left out; a repeated id counts once, by its smallest text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y__"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    least = min(LEAST, bound // 2)
    pick = first(known, bound).union(first(known.where("y__ > 0"), least)).union(first(known.where("y__ <= 0"), least)).distinct()
    # the sample is bounded by a parameter, so its broadcast does not grow with the corpus
    rows = (
        docs.select("doc_id", F.col(text).alias("t__")).where(F.col("t__").isNotNull())
        .join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("t__").alias("t"), F.max("y__").alias("y"))
    )
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("t", "y")


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """fit(rows of the one-partition sample), run as a task: the driver gets the model, not the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    row = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([])  # an empty sample may leave no task to run
