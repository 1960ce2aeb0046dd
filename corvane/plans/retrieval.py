"""Queries of vector search, reranking, windows and statistics over the driver's tables, with their DuckDB forms.

Adapters: `embeddings` stand for chunks (three to a note, the label for folder or book),
`events` for relations (the type of an event for that of a relation, its user for the note).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import context, dedup, scoring, stats, vector
from corvane.session import reach_workers

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = 1_710_000_000.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a chunk table."""
    e, k = load(spark, sf_dir, "embeddings"), F.col("vec_id")
    note = F.concat(F.lit("n"), F.floor(k / 3).cast("string"))
    return e.select(
        k.alias("id"), F.col("embedding").alias("vector"), note.alias("note"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("folder"),
        F.concat(F.lit("f"), F.col("label").cast("string"), F.lit("/"), note, F.lit(".md")).alias("file"), (F.lit(1_700_000_000.0) - k * 86400.0).alias("mtime"),
    )


CHUNKS = """
chunks AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 'n' || (vec_id // 3) AS note, 'f' || label AS folder, 1700000000.0::DOUBLE - vec_id * 86400.0 AS mtime FROM embeddings)"""
ONE = "one AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
NEAR = """
near AS (
  SELECT c.*, 1 - list_cosine_similarity(vector, q) AS distance, round(1 - list_cosine_similarity(vector, q), 12) AS d12,
    round(greatest(0, list_cosine_similarity(vector, q)), 4) AS similarity
  FROM chunks c, one)"""


def example(rows: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k rows nearest to the one of the smallest id (KNN-4); the example is read as a row of its own."""
    one = rows.agg(F.min_by("vector", id_col).alias("query"))
    return vector.top_k_by_example(rows, one, k, key=id_col).withColumn("similarity", vector.similarity(F.col("distance")))


@query(f"WITH {ONE},{CHUNKS},{NEAR} SELECT id, similarity FROM near ORDER BY d12, id LIMIT 10")
def knn_topk(spark, sf_dir):
    """KNN-1, KNN-2, KNN-4, TOP-1."""
    return example(chunks(spark, sf_dir), 10).select("id", "similarity")


@query(f"WITH {ONE},{CHUNKS},{NEAR} SELECT id, folder, similarity FROM near WHERE folder = 'f3' ORDER BY d12, id LIMIT 10")
def knn_folder_filter(spark, sf_dir):
    """KNN-1 with FLT-1 before the search."""
    c = chunks(spark, sf_dir)
    one = c.agg(F.min_by("vector", "id").alias("query"))
    return vector.top_k_by_example(c.where(F.col("folder") == "f3"), one, 10).select("id", "folder", vector.similarity(F.col("distance")).alias("similarity"))


@query(f"""WITH {CHUNKS},
q AS (SELECT id AS qid, vector AS q FROM chunks WHERE id % 100 = 0),
r AS (SELECT qid, id, round(1 - list_cosine_similarity(vector, q), 12) AS d, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_cosine_similarity(vector, q), 12), id) AS rank FROM chunks, q)
SELECT qid, id, rank FROM r WHERE rank <= 5""")
def knn_many_queries(spark, sf_dir):
    """KNN-1 for a table of queries: every row whose id is divisible by 100, against all rows."""
    c = chunks(spark, sf_dir)
    q = c.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    return vector.top_k_many(c.select("id", "vector"), q, 5).select("qid", "id", "rank")


@query("""WITH e AS (SELECT vec_id, CASE vec_id % 10 WHEN 3 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN 7 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) ELSE list_transform(embedding, lambda x: (3 * x)::FLOAT) END AS v FROM embeddings)
SELECT vec_id, CASE vec_id % 10 WHEN 3 THEN 0.0 WHEN 7 THEN -1.0 ELSE round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 4) END AS before, CASE vec_id % 10 WHEN 3 THEN 0.0 WHEN 7 THEN -1.0 ELSE 1.0 END::DOUBLE AS after FROM e""")
def vector_normalise(spark, sf_dir):
    """KNN-5: vectors three times as long, and some that are zero (length 0) or NaN (-1 here), which stay as they are."""
    kind, v = F.col("vec_id") % 10, F.col("embedding")
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(v, lambda x: F.when(kind == 3, F.lit(0.0)).when(kind == 7, F.lit(float("nan"))).otherwise(x * 3).cast("float")).alias("v"))
    length = lambda c: F.round(F.when(F.isnan(vector.norm(c)), -1.0).otherwise(vector.norm(c)), 4)
    return e.select("vec_id", length(F.col("v")).alias("before"), length(vector.normalise(F.col("v"))).alias("after"))


@query(f"""WITH {ONE},{CHUNKS},{NEAR},
hits AS (SELECT * FROM near ORDER BY d12, id LIMIT 60),
first AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY d12, id) AS nth FROM hits),
w AS (
  SELECT *, CASE folder WHEN 'f1' THEN 1.2 WHEN 'f2' THEN 0.8 ELSE 1.0 END AS pw, greatest(0.7, 1 / (1 + ln(1 + greatest(0, ({NOW} - mtime) / 86400) / 365) * 0.3)) AS rw
  FROM first WHERE nth = 1)
SELECT id, note, similarity AS raw_similarity, round(similarity * pw * rw, 4) AS similarity FROM w ORDER BY round(similarity * pw * rw, 4) DESC, d12, id LIMIT 20""")
def search_dedup_rerank(spark, sf_dir):
    """KNN-1 → WIN-1 → SCR-1, SCR-2, SCR-4 → TOP-2."""
    hits = example(chunks(spark, sf_dir), vector.over_fetch("api", 20))
    d = F.round("distance", 12)
    first = dedup.keep_first(hits, "note", d, "id")
    w = first.withColumn("path_weight", scoring.path_weight(F.col("folder"), {"f1": 1.2, "f2": 0.8})).withColumn("recency_weight", scoring.recency_weight(F.col("mtime"), NOW))
    return scoring.rerank(w, factors=("path_weight", "recency_weight"), prior=(d, "id")).limit(20).select("id", "note", "raw_similarity", "similarity")


@query(f"SELECT l_orderkey, l_linenumber, round(greatest(0.7, 1 / (1 + ln(1 + greatest(0, ({NOW} - epoch(l_shipdate)) / 86400) / 365) * 0.3)), 6) AS weight FROM lineitem")
def recency_weight(spark, sf_dir):
    """SCR-2 over a long column."""
    t = F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("double")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.recency_weight(t, NOW), 6).alias("weight"))


RELATIONS = "relations AS (SELECT 'n' || user_id AS source_note, CASE event_type WHEN 'view' THEN 'treats' WHEN 'click' THEN 'causes' WHEN 'error' THEN 'complication_of' WHEN 'purchase' THEN 'diagnoses' ELSE 'part_of' END AS type, event_id FROM events)"


def relations(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in (("view", "treats"), ("click", "causes"), ("error", "complication_of"), ("purchase", "diagnoses")) for x in p])
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("source_note"), F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("part_of")).alias("type"), "event_id",
    )


@query(f"""WITH {CHUNKS},{RELATIONS}, notes AS (SELECT DISTINCT note FROM chunks),
hit AS (SELECT DISTINCT source_note FROM relations WHERE type IN ('treats', 'complication_of'))
SELECT note, CASE WHEN source_note IS NULL THEN 1.0 ELSE 1.15 END::DOUBLE AS relation_weight FROM notes LEFT JOIN hit ON note = source_note""")
def relation_boost(spark, sf_dir):
    """SCR-3, JOIN-12: the query asks for treatment and complications."""
    notes = chunks(spark, sf_dir).select("note").distinct()
    return scoring.relation_weight(notes, relations(spark, sf_dir), "How to TREAT a complication?")


@query(f"""WITH {CHUNKS},
qa AS (SELECT vector AS q FROM chunks ORDER BY id LIMIT 1), qb AS (SELECT vector AS q FROM chunks ORDER BY id DESC LIMIT 1),
a AS (SELECT id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(vector, q), 12), id) - 1 AS r FROM chunks, qa QUALIFY r < 40),
b AS (SELECT id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(vector, q), 12), id) - 1 AS r FROM chunks, qb QUALIFY r < 40)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.r, -1) AS semantic_rank, coalesce(b.r, -1) AS graph_rank, round(coalesce(1 / (60.0 + a.r), 0) + coalesce(1 / (60.0 + b.r), 0), 6) AS fused FROM a FULL JOIN b ON a.id = b.id""")
def rrf_similar(spark, sf_dir):
    """JOIN-5, FUSE-1: two rankings of the chunks."""
    c = chunks(spark, sf_dir)
    lists = []
    for pick in (F.min_by, F.max_by):
        got = vector.top_k_by_example(c, c.agg(pick("vector", "id").alias("query")), 40)
        lists.append(scoring.ranked(got.select("id", F.round("distance", 12).alias("d")), "d", "id"))
    return scoring.fuse(lists[0], lists[1], key="id").fillna(-1, ["semantic_rank", "graph_rank"])


@query(f"""WITH {ONE},{CHUNKS},{NEAR},
hits AS (SELECT id, id // 4 AS parent_id, folder AS book, similarity, d12 FROM near ORDER BY d12, id LIMIT 200),
two AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY similarity DESC, d12, id) AS nth FROM hits QUALIFY nth <= 2),
share AS (SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM two GROUP BY book)),
three AS (SELECT two.*, row_number() OVER (PARTITION BY book ORDER BY similarity DESC, d12, id) AS bth, share FROM two, share)
SELECT id, parent_id, book, similarity FROM three WHERE share <= 0.05 OR bth <= 3""")
def longform_diversity(spark, sf_dir):
    """WIN-2, WIN-3, AGG-10; the share is set low so that the cap applies."""
    hits = example(chunks(spark, sf_dir), 200).withColumn("parent_id", F.floor(F.col("id") / 4)).withColumn("book", F.col("folder"))
    order = (F.desc("similarity"), F.round("distance", 12), F.col("id"))
    return dedup.diversify(dedup.keep_n(hits, "parent_id", 2, *order), "book", *order, share=0.05).select("id", "parent_id", "book", "similarity")


@query(f"""WITH {ONE},{CHUNKS},{NEAR},
hits AS (SELECT id // 4 AS parent_id, row_number() OVER (ORDER BY d12, id) - 1 AS rank FROM near QUALIFY rank < 100),
f AS (SELECT parent_id, min(rank) AS first FROM hits GROUP BY parent_id)
SELECT parent_id, row_number() OVER (ORDER BY first, parent_id) - 1 AS place FROM f""")
def parent_order(spark, sf_dir):
    """WIN-5."""
    hits = scoring.ranked(example(chunks(spark, sf_dir), 100).withColumn("d", F.round("distance", 12)), "d", "id").withColumn("parent_id", F.floor(F.col("id") / 4))
    return dedup.parent_order(hits)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_size AS n FROM part),
g AS (
  SELECT n, 0 AS k, least(4000, 12000) AS given, 12000 - 4000 AS rem FROM n
  UNION ALL
  SELECT n, k + 1, CASE WHEN k + 1 = 1 THEN least(2000, rem) ELSE least(greatest(400, rem // greatest(1, n - (k + 1))), 4000, rem) END,
    rem - CASE WHEN k + 1 = 1 THEN least(2000, rem) ELSE least(greatest(400, rem // greatest(1, n - (k + 1))), 4000, rem) END
  FROM g WHERE k + 1 < n)
SELECT n, k AS place, given AS budget FROM g""")
def parent_budget(spark, sf_dir):
    """WIN-6 for every number of parents from 1 to 50."""
    n = load(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.posexplode(dedup.budgets(F.col("n"))).alias("place", "budget"))


@query("""SELECT doc_id, source || '_' || (1995 + doc_id % 40) AS book,
round((n_chars % 1000) / 1000.0 + CASE source WHEN 'src1' THEN 0.05 WHEN 'src2' THEN -0.02 ELSE 0 END + CASE WHEN 1995 + doc_id % 40 < 2000 THEN 0 ELSE least((1995 + doc_id % 40 - 2000) * 0.001, 0.025) END, 4)::DOUBLE AS boosted FROM documents""")
def source_boost(spark, sf_dir):
    """SCR-5, SCR-6."""
    book = F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 40 + 1995).cast("string"))
    d = load(spark, sf_dir, "documents").select("doc_id", book.alias("book"), "n_chars", "source")
    flat = scoring.source_boost(F.col("n_chars") % 1000 / 1000.0 + F.when(F.col("source") == "src1", 0.05).when(F.col("source") == "src2", -0.02).otherwise(0.0), F.col("book"), {"_remark": 1})
    return d.select("doc_id", "book", flat.alias("boosted"))


@query("SELECT p_partkey, CASE WHEN 1990 + p_size < 2000 THEN 0 ELSE least((1990 + p_size - 2000) * 0.001, 0.025) END::DOUBLE AS boost FROM part")
def edition_boost(spark, sf_dir):
    """SCR-6."""
    p = load(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("_"), (F.col("p_size") + 1990).cast("string"))
    return p.select("p_partkey", F.round(scoring.edition_boost(name), 6).alias("boost"))


@query(f"WITH {ONE},{CHUNKS},{NEAR} SELECT id, CASE WHEN similarity >= 0.7 THEN 'primary' WHEN similarity >= 0.5 THEN 'secondary' ELSE 'hidden' END AS tier FROM near")
def tiering(spark, sf_dir):
    """FLT-6 over all chunks."""
    c = chunks(spark, sf_dir)
    one = c.agg(F.min_by("vector", "id").alias("query"))
    sim = c.crossJoin(F.broadcast(one)).withColumn("similarity", vector.similarity(vector.cosine_distance(F.col("vector"), F.col("query"))))
    return sim.select("id", context.tier(F.col("similarity")).alias("tier"))


@query("SELECT doc_id, source FROM documents WHERE NOT (contains(lower(source), 'src1') OR contains(lower(lang), 'fr') OR contains(lower(source), 'rc7'))")
def exclusion_filter(spark, sf_dir):
    """FLT-3."""
    d = load(spark, sf_dir, "documents")
    return context.exclude(context.exclude(d, ["SRC1", "rc7"], "source"), ["fr"], "lang").select("doc_id", "source")


@query("SELECT page_id FROM pages WHERE NOT starts_with(lower(regexp_replace(url, '^https?://', '')), 'blog.theren.example.net/')")
def folder_exclusion(spark, sf_dir):
    """FLT-4."""
    p = load(spark, sf_dir, "pages").withColumn("file", F.regexp_replace("url", "^https?://", ""))
    return context.exclude_folders(p, ["Blog.theren.example.net"]).select("page_id")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part),
k AS (SELECT name, CASE WHEN name = 'red' THEN 0 WHEN starts_with(name, 'red') THEN 1 WHEN contains(name, 'red') THEN 2 WHEN regexp_matches(name, 'r.*e.*d') THEN 3 END AS kind FROM n)
SELECT name, kind FROM k WHERE kind IS NOT NULL ORDER BY kind, length(name), name LIMIT 10""")
def fuzzy_autocomplete(spark, sf_dir):
    """TOP-5, SCL-5."""
    return context.autocomplete(load(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "Red").select("name", "kind")


@query("SELECT source, count(*) AS chunks, count(DISTINCT lang) AS files FROM documents GROUP BY source")
def stats_by_folder(spark, sf_dir):
    """AGG-1, AGG-2."""
    return stats.by_group(load(spark, sf_dir, "documents"), "source", file="lang")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, (SELECT count(*) FROM benchmark) AS parents FROM documents")
def stats_overall(spark, sf_dir):
    """AGG-1, AGG-2, SNK-11 totals."""
    return stats.overall(load(spark, sf_dir, "documents"), file="source", parents=load(spark, sf_dir, "benchmark"))


@query(f"""WITH {CHUNKS}, q AS (SELECT folder AS qid, arg_min(vector, id) AS q FROM chunks GROUP BY folder),
r AS (SELECT qid, id, id // 4 AS parent_id, round(greatest(0, list_cosine_similarity(vector, q)), 4) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_cosine_similarity(vector, q), 12), id) AS rank FROM chunks, q QUALIFY rank <= 60),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) = 1 AND rank <= 40 AS kept FROM r)
SELECT qid, round(stddev_pop(s) FILTER (WHERE kept), 4) AS score_std, round(list_sort(list(s) FILTER (WHERE kept), 'DESC')[1] - list_sort(list(s) FILTER (WHERE kept), 'DESC')[2], 4) AS top_gap,
  round(count(DISTINCT parent_id) / count(*), 3) AS unique_parent_ratio_raw, round(count(DISTINCT parent_id) FILTER (WHERE kept) / count(*) FILTER (WHERE kept), 3) AS unique_parent_ratio FROM k GROUP BY qid""")
def search_log_metrics(spark, sf_dir):
    """AGG-8, AGG-9 of ten queries' sixty results: raw, and of the first forty one to a parent."""
    from pyspark.sql import Window

    c = chunks(spark, sf_dir)
    q = c.groupBy(F.col("folder").alias("qid")).agg(F.min_by("vector", "id").alias("query"))
    hits = vector.top_k_many(c, q, 60).withColumn("similarity", vector.similarity(F.col("distance"))).withColumn("parent_id", F.floor(F.col("id") / 4))
    first = F.row_number().over(Window.partitionBy("qid", "parent_id").orderBy("rank")) == 1
    return stats.score_metrics(hits.withColumn("kept", first & (F.col("rank") <= 40)), kept=F.col("kept"))


@query("SELECT max(n) / sum(n) AS share, arg_max(source, (n, source)) AS \"group\" FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def dominant_share(spark, sf_dir):
    """AGG-10."""
    return stats.dominant_share(load(spark, sf_dir, "documents"), "source")


@query(f"""WITH {RELATIONS}, r AS (SELECT DISTINCT source_note, type FROM relations),
n AS (SELECT note, row_number() OVER (ORDER BY note) - 1 AS rank FROM (SELECT DISTINCT source_note AS note FROM relations) QUALIFY rank < 30)
SELECT source_note, type FROM n JOIN r ON note = source_note ORDER BY rank, type LIMIT 15""")
def result_relations(spark, sf_dir):
    """JOIN-3: the relations of a result list, fifteen at most."""
    from corvane.operators import entities

    r = relations(spark, sf_dir).select("source_note", "type").distinct().withColumn("from", F.lit("")).withColumn("to", F.lit(""))
    notes = scoring.ranked(r.select(F.col("source_note").alias("note")).distinct().orderBy("note").limit(30), "note")
    return entities.relations_of(notes, r).select("source_note", "type")


@query(f"""WITH {ONE},{CHUNKS},{NEAR}, hits AS (SELECT *, row_number() OVER (ORDER BY d12, id) - 1 AS rank FROM near QUALIFY rank < 25)
SELECT string_agg((rank + 1) || '. **' || note || '** · ' || folder || ' · sim ' || printf('%.2f', similarity), chr(10) ORDER BY rank) AS markdown FROM hits""")
def render_results(spark, sf_dir):
    """REN-1, REN-2, SCL-9."""
    hits = scoring.ranked(example(chunks(spark, sf_dir), 25).withColumn("d", F.round("distance", 12)), "d", "id")
    return context.render_results(hits.select("rank", "note", "folder", "similarity", F.lit("").alias("section"), F.lit("").alias("tags"), F.lit("").alias("text")))


@query(f"""WITH {ONE},{CHUNKS},{NEAR}, hits AS (SELECT *, row_number() OVER (ORDER BY d12, id) - 1 AS rank FROM near QUALIFY rank < 25)
SELECT string_agg('### ' || (rank + 1) || '. ' || folder || ' › ' || note || ' · p.' || (id + 1) || '-' || (id + 2) || ' · sim ' || printf('%.2f', similarity) || chr(10) || folder || '/' || note || '.md' || chr(10) || chr(10) || 'text' || id || chr(10) || chr(10) || 'Figures: Fig 1-' || id, chr(10) || chr(10) ORDER BY rank) AS markdown FROM hits""")
def render_longform(spark, sf_dir):
    """REN-3."""
    hits = scoring.ranked(example(chunks(spark, sf_dir), 25).withColumn("d", F.round("distance", 12)), "d", "id")
    i = F.col("id")
    return context.render_longform(hits.select(
        "rank", F.col("folder").alias("book"), F.col("note").alias("section_path"), (i + 1).alias("page_start"), (i + 2).alias("page_end"), "file", "similarity",
        F.concat(F.lit("text"), i.cast("string")).alias("parent_text"), F.array(F.concat(F.lit("Fig 1-"), i.cast("string"))).alias("figure_ids"),
    ))


@query(f"""WITH {CHUNKS}, keys AS (SELECT DISTINCT 'n' || user_id AS note FROM events) SELECT id, note FROM chunks SEMI JOIN keys USING (note)""")
def point_lookup(spark, sf_dir):
    """FLT-2: rows by a list of keys."""
    keys = relations(spark, sf_dir).select(F.col("source_note").alias("note"))
    return context.by_keys(chunks(spark, sf_dir), keys, "note").select("id", "note")
