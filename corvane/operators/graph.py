"""Link graphs (GRF-*): building, Personalized PageRank, k-hop neighbourhoods.

PageRank has two executions of one definition. Up to `kernel_edges` edges, the edge
list goes through the driver (so the bound is small), is broadcast, and every seed set is
one row of a mapped batch, so a thousand queries run in parallel without a shuffle. Beyond
that, scores are a DataFrame that is joined with the edges in every iteration and staged to
the shared folder every few iterations, so that neither the plan nor the loss of an executor
grows with the run. These joins are merge joins whatever the sizes: the broadcasts that the
planner would choose instead pass the driver in every iteration, and grow with the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.sources.staging import release, stage

DAMPING, ITERATIONS = 0.85, 30


def staged(df: DataFrame) -> DataFrame:
    return stage(df, "graph")[0]


def note_links(notes: DataFrame, *, content: str = "content", note: str = "note") -> DataFrame:
    """TXT-22 over a corpus: one directed (src, dst) row per distinct link."""
    return notes.select(F.col(note).alias("src"), F.explode(tx.wiki_links(F.col(content), F.col(note))).alias("dst")).distinct()


def symmetric(links: DataFrame) -> DataFrame:
    """SET-2, GRF-1: both directions of every link, once; targets that are no notes stay in."""
    return links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def _kernel(edges: DataFrame, seeds: DataFrame, damping: float, iterations: int) -> DataFrame:
    spark = seeds.sparkSession
    frame = edges.select("src", "dst").toPandas()  # at most kernel_edges rows
    code, names = pd.factorize(np.concatenate([frame["src"].to_numpy(object), frame["dst"].to_numpy(object)]))  # names stay as long as they are
    src, dst = code[: len(frame)], code[len(frame) :]
    shared = spark.sparkContext.broadcast((names, src, dst, np.bincount(src, minlength=len(names))))

    def run(frames):
        names, src, dst, degree = shared.value
        place = {n: i for i, n in enumerate(names)}
        for f in frames:
            for sid, group in zip(f["seed_set"], f["nodes"], strict=True):
                wanted = list(dict.fromkeys(x for x in group if x))
                if not wanted:
                    continue
                restart = np.zeros(len(names))
                lost = {}
                for x in wanted:
                    if x in place:
                        restart[place[x]] = 1 / len(wanted)
                    else:
                        lost[x] = 1 / len(wanted)  # unlinked seeds hold their restart mass and pass none on
                score = restart
                for _ in range(iterations):
                    share = damping * score / np.maximum(degree, 1)
                    score = np.bincount(dst, weights=share[src], minlength=len(names)) + (1 - damping) * restart
                hit = np.flatnonzero(score)
                yield pd.DataFrame({"seed_set": sid, "note": [*names[hit], *lost], "score": [*score[hit], *[(1 - damping) * v if iterations else v for v in lost.values()]]})

    kind = seeds.schema["seed_set"].dataType.simpleString()
    grouped = seeds.where(F.col("node") != "").groupBy("seed_set").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return grouped.mapInPandas(run, f"seed_set {kind}, note string, score double")


def _joined(edges: DataFrame, seeds: DataFrame, damping: float, iterations: int, every: int) -> DataFrame:
    out = staged(edges.join(degrees(edges).hint("merge"), "src").select("src", "dst", "degree"))
    distinct = seeds.where(F.col("node") != "").select("seed_set", "node").distinct()
    count = distinct.groupBy("seed_set").agg(F.count(F.lit(1)).alias("n"))
    restart = staged(distinct.join(count, "seed_set").select("seed_set", F.col("node").alias("note"), (1 / F.col("n")).alias("score")))
    score, path = restart, None
    for i in range(iterations):
        moved = score.hint("merge").join(out, score["note"] == out["src"]).select("seed_set", F.col("dst").alias("note"), (damping * F.col("score") / F.col("degree")).alias("score"))
        back = restart.select("seed_set", "note", (F.col("score") * (1 - damping)).alias("score"))
        score = moved.unionByName(back).groupBy("seed_set", "note").agg(F.sum("score").alias("score"))
        if (i + 1) % every == 0 and i + 1 < iterations:
            score, now = stage(score, "graph")
            if path:
                release(seeds.sparkSession, path)
            path = now
    return score


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS, kernel_edges: int = 200_000, every: int = 5) -> DataFrame:
    """GRF-2: (seed_set, note, score) for every seed set of `seeds` (seed_set, node): a fixed number of iterations, no convergence test.

    Equal seeds count once; mass that reaches a node without links is lost.
    """
    if edges.limit(kernel_edges + 1).count() <= kernel_edges:
        return _kernel(edges, seeds, damping, iterations)
    return _joined(edges, seeds, damping, iterations, every)


def best(scores: DataFrame, k: int, *, drop: DataFrame | None = None, decimals: int = 9) -> DataFrame:
    """TOP-3: per seed set the k highest scores (ties by name) but for the (seed_set, node) rows in drop."""
    from pyspark.sql import Window

    df = scores.withColumn("score", F.round("score", decimals))
    if drop is not None:
        df = df.join(drop.select("seed_set", F.col("node").alias("note")).distinct(), ["seed_set", "note"], "left_anti")
    w = Window.partitionBy("seed_set").orderBy(F.desc("score"), "note")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def related(edges: DataFrame, note: str, k: int = 20, **options) -> DataFrame:
    """GRF-3: the notes nearest to one note."""
    seeds = edges.sparkSession.createDataFrame([(0, note)], "seed_set int, node string")
    return best(personalized_pagerank(edges, seeds, **options), k, drop=seeds)


def expand(edges: DataFrame, results: DataFrame, *, seeds: int = 5, k: int = 15, emit: int = 10, **options) -> DataFrame:
    """GRF-4: notes linked with a result list (seed_set, note, rank): its first few are the seeds, all of it is left out."""
    chosen = results.where(F.col("rank") < seeds).select("seed_set", F.col("note").alias("node"))
    every = results.select("seed_set", F.col("note").alias("node"))
    return best(personalized_pagerank(edges, chosen, **options), k, drop=every).where(F.col("rank") <= emit)


def k_hop(edges: DataFrame, start: DataFrame, hops: int, *, real: DataFrame | None = None) -> DataFrame:
    """GRF-5: (note, hop) within so many links of `start` (note), the start left out; `real` (note) keeps known notes only."""
    seen = start.select("note").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        fresh = front.join(edges, front["note"] == edges["src"]).select(F.col("dst").alias("note")).distinct().join(seen, "note", "left_anti").withColumn("hop", F.lit(h))
        front = staged(fresh)
        seen = seen.unionByName(front)
    out = seen.where("hop > 0")
    return out.join(real.select("note").distinct(), "note", "left_semi") if real is not None else out


def totals(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-5: notes, notes with links and half the sum of degrees, in one row."""
    deg = degrees(edges).join(notes.select(F.col("note").alias("src")).distinct(), "src", "left_semi")
    linked = deg.agg(F.count(F.lit(1)).alias("notes_with_links"))
    pairs = edges.agg(F.floor(F.count(F.lit(1)) / 2).alias("total_edges"))
    return notes.agg(F.countDistinct("note").alias("total_notes")).crossJoin(linked).crossJoin(pairs)
