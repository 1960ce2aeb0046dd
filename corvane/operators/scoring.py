"""Reranking weights (SCR-*) and rank fusion (FUSE-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vocabulary import RELATION_BOOST, intent_map

RECENCY_SCALE, RECENCY_DAYS, RECENCY_FLOOR, FUSION_K = 0.3, 365.0, 0.70, 60


def _literal_map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map().cast("map<string,double>")


def path_weight(folder: Column, weights: dict[str, float], *, archive: str | None = None, include_archived: bool = False) -> Column:
    """SCR-1: the folder's weight, 1 if it has none, or for the archive when that is asked for."""
    found = F.coalesce(F.element_at(_literal_map({k: float(v) for k, v in weights.items()}), folder), F.lit(1.0))
    return F.when(folder == archive, F.lit(1.0)).otherwise(found) if archive and include_archived else found


def recency_weight(mtime: Column, now: float) -> Column:
    """SCR-2: slow logarithmic decay with a floor; unknown times weigh 1."""
    t = F.when(F.isnan(mtime), F.lit(None)).otherwise(mtime).cast("double")
    days = F.greatest(F.lit(0.0), (F.lit(float(now)) - t) / 86400)
    return F.coalesce(F.greatest(F.lit(RECENCY_FLOOR), 1 / (1 + F.log1p(days / RECENCY_DAYS) * RECENCY_SCALE)), F.lit(1.0))


def intents(query: str) -> list[str]:
    """JOIN-12: the relation types that a query's words ask for."""
    q = query.lower()
    return sorted({kind for word, kind in intent_map().items() if word in q})


def relation_weight(results: DataFrame, relations: DataFrame, query: str, *, note: str = "note", out: str = "relation_weight") -> DataFrame:
    """SCR-3: RELATION_BOOST for notes with a relation of a type that the query asks for, else 1."""
    wanted = intents(query) if query else []
    if not wanted:
        return results.withColumn(out, F.lit(1.0))
    noted = relations.where(F.col("type").isin(wanted)).select(F.col("source_note").alias(note)).distinct().withColumn("has__", F.lit(True))
    return results.join(noted, note, "left").withColumn(out, F.when(F.col("has__"), F.lit(RELATION_BOOST)).otherwise(F.lit(1.0))).drop("has__")


def rerank(results: DataFrame, *, raw: str = "similarity", factors: tuple[str, ...] = ("path_weight", "recency_weight", "relation_weight"), prior: tuple[str, ...] = ()) -> DataFrame:
    """SCR-4: similarity times its weights, four decimals; the old value stays as raw_similarity; ties keep the prior order."""
    product = F.col(raw)
    for f in factors:
        product = product * F.col(f)
    return results.withColumn("raw_similarity", F.col(raw)).withColumn(raw, F.round(product, 4)).orderBy(F.desc(raw), *prior)


def edition_boost(name: Column) -> Column:
    """SCR-6: a thousandth for each year after 2000 of a name ending in _YYYY, 0.025 at most."""
    year = F.regexp_extract(name, r"_(\d{4})", 1)
    y = F.when(year != "", year.cast("int"))
    return F.coalesce(F.when(y >= 2000, F.least((y - 2000) * F.lit(0.001), F.lit(0.025))), F.lit(0.0))


def source_boost(sim: Column, book: Column, boosts: dict[str, float]) -> Column:
    """SCR-5: similarity plus the book's boost plus its edition's, four decimals."""
    listed = {k: float(v) for k, v in boosts.items() if not k.startswith("_")}
    return F.round(sim + F.coalesce(F.element_at(_literal_map(listed), book), F.lit(0.0)) + edition_boost(book), 4)


def fuse(semantic: DataFrame, graph: DataFrame, *, key: str = "note", k: int = FUSION_K) -> DataFrame:
    """JOIN-5, FUSE-1: (key, rank) lists of 0-based ranks to their reciprocal-rank sum, six decimals."""
    a, b = semantic.select(key, F.col("rank").alias("ra")), graph.select(key, F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1 / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, F.col("ra").alias("semantic_rank"), F.col("rb").alias("graph_rank"), F.round(part("ra") + part("rb"), 6).alias("fused"))


def ranked(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """0-based rank of a bounded result list (top-k output, never a corpus: the window has one partition)."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) - 1)
