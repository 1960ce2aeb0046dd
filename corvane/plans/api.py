"""The query surface: search, related, similar, long-form search, statistics, contexts - each a function to a DataFrame.

Profiles carry the differences between the two front ends of the same search: how
many rows are fetched, whether derived notes are excluded, whether sources are boosted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import context, dedup, entities, graph, scoring, vector


@dataclass
class Profile:
    """Settings of a search."""

    fetch: str = "api"
    most: int = 30
    path_weights: dict[str, float] = field(default_factory=dict)
    archive: str | None = None
    include_archived: bool = False
    boost_recent: bool = True
    exclude: list[str] = field(default_factory=list)
    source_boost: dict[str, float] | None = None


API = Profile()
TOOL = Profile(fetch="tool", exclude=["derived/"])


def checked(n: int, most: int, *, clamp: bool = False) -> int:
    """TOP-2: a number of results within 1..most; the tool front end clamps the upper end, the other one refuses."""
    if clamp and n > most:
        return most
    if not 1 <= n <= most:
        raise ValueError(f"n_results is within 1..{most}")
    return n


def search(chunks: DataFrame, query: Sequence[float], n: int = 20, *, now: float, query_text: str = "", folder: str | None = None, relations: DataFrame | None = None, profile: Profile = API) -> DataFrame:
    """KNN-1 → FLT-3 → WIN-1 → SCR-1..4 → first n; (rank, note, ..., similarity, raw_similarity)."""
    n = checked(n, profile.most, clamp=profile.fetch == "tool")
    hits = vector.top_k(chunks, query, vector.over_fetch(profile.fetch, n), where=F.col("folder") == folder if folder else None)
    hits = hits.withColumn("similarity", vector.similarity(F.col("distance"))).drop("vector")
    if profile.exclude:
        hits = context.exclude(hits, profile.exclude, "file", "folder")
    first = dedup.keep_first(hits, "note", F.round("distance", 12), "id")
    return _weighted(first, n, now=now, query_text=query_text, relations=relations, profile=profile, prior=(F.round("distance", 12), F.col("id")))


def _weighted(df: DataFrame, n: int, *, now: float, query_text: str, relations: DataFrame | None, profile: Profile, prior: tuple) -> DataFrame:
    df = df.withColumn("path_weight", scoring.path_weight(F.col("folder"), profile.path_weights, archive=profile.archive, include_archived=profile.include_archived))
    df = df.withColumn("recency_weight", scoring.recency_weight(F.col("mtime"), now) if profile.boost_recent else F.lit(1.0))
    df = scoring.relation_weight(df, relations, query_text) if relations is not None else df.withColumn("relation_weight", F.lit(1.0))
    best = scoring.rerank(df, prior=prior).limit(n)
    return scoring.ranked(best, F.desc("similarity"), *prior)


def search_expanded(results: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-4 on one result list (note, rank)."""
    return graph.expand(edges, results.select(F.lit(0).alias("seed_set"), "note", "rank"))


def related(edges: DataFrame, notes: DataFrame, note: str, n: int = 12, *, existing_only: bool = False) -> DataFrame:
    """GRF-3, JOIN-2: (rank, note, score, file, folder); linked names that are no notes have empty ones, or go."""
    got = graph.related(edges, note, checked(n, 30) if not existing_only else 1000).drop("seed_set")
    known = notes.select("note", "file", "folder")
    if existing_only:
        got = got.join(known, "note").orderBy("rank").limit(n)
        return got.select("note", "score", "file", "folder", F.col("rank"))
    return got.join(known, "note", "left").select("note", "score", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("folder", F.lit("")).alias("folder"), "rank")


def similar(chunks: DataFrame, edges: DataFrame, note: str, n: int = 10, *, now: float, profile: Profile = API) -> DataFrame:
    """KNN-4 → KNN-1 → WIN-1, with GRF-3 by FUSE-1, then SCR-4; graph-only notes have no time and weigh 1 by recency."""
    n = checked(n, 30)
    example = chunks.where(F.col("note") == note).agg(F.min_by("vector", "id").alias("query")).where("query IS NOT NULL")
    hits = vector.top_k_by_example(chunks, example, vector.over_fetch("similar", n)).where(F.col("note") != note)
    first = dedup.keep_first(hits, "note", F.round("distance", 12), "id").select("note", "folder", "mtime", F.round("distance", 12).alias("d"), "id")
    semantic = scoring.ranked(first, "d", "id")
    linked = graph.related(edges, note, max(3 * n, 40)).select("note", (F.col("rank") - 1).alias("rank"))
    fused = scoring.fuse(semantic, linked).join(semantic.select("note", "folder", "mtime"), "note", "left").withColumn("folder", F.coalesce("folder", F.lit("")))
    fused = fused.withColumn("similarity", F.col("fused"))
    return _weighted(fused, n, now=now, query_text="", relations=None, profile=profile, prior=(F.desc("fused"), F.col("note")))


def longform_search(children: DataFrame, parents: DataFrame, query: Sequence[float], n: int = 20, *, book: str | None = None, full_parent: bool = True, profile: Profile = API) -> DataFrame:
    """KNN-1 → SCR-5 → FLT-3 → WIN-2 → WIN-3 → n → WIN-5/6 → JOIN-1 with the parents' texts cut to their budgets."""
    n = checked(n, 50, clamp=profile.fetch == "tool")
    hits = vector.top_k(children, query, vector.over_fetch("longform", n), where=F.col("book") == book if book else None)
    hits = hits.withColumn("similarity", vector.similarity(F.col("distance"))).drop("vector")
    if profile.source_boost is not None:
        hits = hits.withColumn("similarity", scoring.source_boost(F.col("similarity"), F.col("book"), profile.source_boost))
    if profile.exclude:
        hits = context.exclude(hits, profile.exclude, "file", "book")
    order = (F.desc("similarity"), F.round("distance", 12), F.col("id"))
    few = dedup.keep_n(hits, "parent_id", 2, *order)
    if not book:
        few = dedup.diversify(few, "book", *order)
    top = scoring.ranked(few.orderBy(*order).limit(n), *order)
    order_of = dedup.parent_order(top)
    grants = dedup.budgets(F.col("n")) if full_parent else F.array_repeat(F.lit(800), F.col("n").cast("int"))
    budget = order_of.crossJoin(order_of.agg(F.count(F.lit(1)).cast("int").alias("n"))).select("parent_id", F.get(grants, F.col("place").cast("int")).alias("budget"))
    text = tx.truncate_tokens(F.col("parent_full"), F.col("budget"))
    wanted = context.by_keys(parents, top.select("parent_id"))
    return (
        context.with_parents(top.join(budget, "parent_id"), wanted)
        .withColumn("parent_text", text).withColumn("truncated", F.col("parent_text") != F.col("parent_full")).drop("parent_full")
    )


def log_row(results: DataFrame, *, query: str, raw: DataFrame) -> DataFrame:
    """T8: the log entry of a search: numbers of raw and kept rows, score spread, distinct parents."""
    from corvane.operators import stats

    kept = stats.score_metrics(results.withColumn("qid", F.lit(0)))
    n = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.round(F.countDistinct("parent_id") / F.count(F.lit(1)), 3).alias("raw_parent_ratio"))
    return kept.drop("qid", "unique_parent_ratio_raw").crossJoin(n).withColumn("query", F.lit(query)).withColumn("ts", F.current_timestamp())


def longform_hits(children: DataFrame, query: Sequence[float], n: int = 5, *, boost: dict[str, float] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """KNN-3 → SCR-5 → FLT-5 → WIN-4 → first max(5, n), with the text of the pages around (TXT-26; lines as page_context takes them) or the chunk's own."""
    n = max(5, n)
    hits = vector.top_k(children, query, vector.over_fetch("chat_longform", n)).withColumn("similarity", vector.similarity(F.col("distance")))
    hits = hits.withColumn("similarity", scoring.source_boost(F.col("similarity"), F.col("book"), boost or {}))
    order = (F.desc("similarity"), F.round("distance", 12), F.col("id"))
    top = scoring.ranked(dedup.keep_n(context.floor(hits), "book", 2, *order).orderBy(*order).limit(n), *order)
    if pages is None:
        return top
    wide = context.page_context(top.select("file", F.col("page_start").alias("page")), pages).select("file", F.col("hit_page").alias("page_start"), "context")
    return top.join(wide, ["file", "page_start"], "left").withColumn("text", F.coalesce(F.nullif(F.col("context"), F.lit("")), F.col("text"))).drop("context")


def chat_context(
    chunks: DataFrame, children: DataFrame | None, query: Sequence[float], n: int = 5, *, now: float, profile: Profile = API, boost: dict[str, float] | None = None, pages: DataFrame | None = None,
) -> DataFrame:
    """CTX-3, CTX-4: the blocks of the notes half and the long-form half of an answer's context, in one text."""
    notes = search(chunks, query, n, now=now, profile=profile)
    blocks = context.rag_blocks(context.floor(notes), cut=1500)
    if children is not None:
        top = longform_hits(children, query, n, boost=boost, pages=pages)
        blocks = blocks.unionByName(context.rag_blocks(top.withColumn("rank", F.col("rank") + n).withColumn("section", F.col("section_path")), cut=3000, longform=True))
    return context.join_blocks(blocks)


def annotate(results: DataFrame, relations: DataFrame, ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOIN-3, JOIN-4 of a result list."""
    return entities.relations_of(results, relations), entities.entities_of(results, ents)


def latest_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("nth__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth__ = 1").drop("nth__")
