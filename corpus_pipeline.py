"""The corpus pipeline: toxicity, quality, near-dedup, decontamination and mixing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of `documents`; the last adds n_tokens, epoch and position and is sorted by position.

Defined cases: null and empty texts are neither toxic nor copies and are judged by the quality
classifier like any other; they have no tokens and so no place in the mix. Documents with a null id pass every
filter that does not reject their text. Rows that repeat an id leave one row in near-dedup, that of the smallest text. A
very long text is judged as a whole. Columns of `documents` beyond its own pass through, also those named like the ones that the
last stage adds (these then get an underscore). Without labels nothing is rejected, without a benchmark nothing is
cut, and an empty table stays empty.

What a stage has put into the shared folder for its own result is deleted when the next stage begins, for
by then the result has been written. What `run` returns stays readable until the session ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chosen_path, decontamination, mixing, quality, toxicity
from corvane.llm.common import release, stage, table
from corvane.session import reach_workers
from corvane.sources.staging import staged


def _stage_of(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The step, with the tables staged for the stage before it released."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, *_left)
        with staged() as paths:
            out = step(spark, docs, sf_dir)
        _left[:] = paths
        return out

    return run_step


#: Paths staged by the stage before.
_left: list[str] = []


@_stage_of
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage_of
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage_of
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return chosen_path.drop_near_duplicates(docs)


@_stage_of
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage_of
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, mixing.SCHEDULE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Two of the stages are fitted networks or regressions, one an approximate join: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = stage(docs, name)
            if before:
                release(spark, before)
            before = path
    _left.clear()
    return docs
