"""Corpus statistics and search metrics (AGG-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_group(chunks: DataFrame, group: str, *, file: str = "file") -> DataFrame:
    """AGG-1, AGG-2: chunks and distinct files of each group, the largest first."""
    return chunks.groupBy(group).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(file).alias("files")).orderBy(F.desc("chunks"), group)


def overall(chunks: DataFrame, *, file: str = "file", parents: DataFrame | None = None) -> DataFrame:
    out = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(file).alias("files"))
    return out.crossJoin(parents.agg(F.count(F.lit(1)).alias("parents"))) if parents is not None else out


def relation_histogram(relations: DataFrame) -> DataFrame:
    """AGG-3: relations by canonical type."""
    from corvane.operators.entities import normalise_relation

    return relations.select(normalise_relation(F.col("type")).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def degree_top(edges: DataFrame, k: int = 10) -> DataFrame:
    """AGG-4: the notes of most links, with the average beside."""
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    mean = deg.agg(F.round(F.avg("degree"), 6).alias("avg_degree"))
    return deg.orderBy(F.desc("degree"), "src").limit(k).crossJoin(F.broadcast(mean))


def entity_totals(entities: DataFrame) -> DataFrame:
    """AGG-6: entities of each note."""
    return entities.groupBy("note").agg(F.count(F.lit(1)).alias("n_entities"))


def score_metrics(results: DataFrame, *, by: str = "qid", score: str = "similarity", parent: str = "parent_id", kept: Column | None = None) -> DataFrame:
    """AGG-8, AGG-9: per query the population deviation of the scores, the gap between the first two, the share of distinct parents."""
    keep = kept if kept is not None else F.lit(True)
    ordered = F.reverse(F.array_sort(F.collect_list(F.when(keep, F.col(score)))))
    return results.groupBy(by).agg(
        F.round(F.stddev_pop(F.when(keep, F.col(score))), 4).alias("score_std"),
        F.round(F.coalesce(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)), F.lit(0.0)), 4).alias("top_gap"),
        F.round(F.countDistinct(parent) / F.count(F.lit(1)), 3).alias("unique_parent_ratio_raw"),
        F.round(F.countDistinct(F.when(keep, F.col(parent))) / F.count_if(keep), 3).alias("unique_parent_ratio"),
    )


def dominant_share(results: DataFrame, group: str) -> DataFrame:
    """AGG-10: the largest group's share of a result list."""
    n = results.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("share"), F.max_by(group, F.struct("n", group)).alias("group"))


def running_usage(turns: DataFrame, tokens: Column) -> DataFrame:
    """AGG-12: tokens so far in each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("tokens", tokens).withColumn("total_tokens", F.sum("tokens").over(w))


def run_counters(files: DataFrame) -> DataFrame:
    """AGG-13: what an index run did, from (state, ok, n_chunks) rows of its files."""
    done = F.col("state").isin("new", "modified")
    return files.agg(
        F.count_if(done & F.col("ok")).alias("processed"), F.count_if(F.col("state") == "unchanged").alias("skipped"), F.count_if(~F.col("ok")).alias("errors"),
        F.count_if(done & F.col("ok") & (F.col("n_chunks") == 0)).alias("short"), F.coalesce(F.sum(F.when(done & F.col("ok"), F.col("n_chunks"))), F.lit(0)).alias("chunks"),
    )
