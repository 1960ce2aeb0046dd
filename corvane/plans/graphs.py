"""Queries of link graphs, entities, relations and change tracking, with their DuckDB forms.

Adapters: a page and the targets of its links make a link graph; link targets
also stand for the entities of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import changes, entities, graph, stats
from corvane.plans.retrieval import QUERIES as _known
from corvane.plans.retrieval import load
from corvane.sources.staging import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in _known:
            raise KeyError(f.__name__)
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def links(spark, sf_dir) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))))
    return p.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("src"), target.alias("dst")).where("dst != ''").distinct()


LINKS = r"""links AS (SELECT DISTINCT 'page' || page_id AS src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS dst FROM pages),
edges AS (SELECT src, dst FROM links WHERE dst <> '' UNION SELECT dst, src FROM links WHERE dst <> '')"""


def edges(spark, sf_dir) -> DataFrame:
    return graph.symmetric(links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT src, dst FROM edges")
def link_graph_edges(spark, sf_dir):
    """GRF-1, SET-2."""
    return edges(spark, sf_dir)


@query(f"WITH {LINKS}, deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src) SELECT src, degree, (SELECT round(avg(degree), 6) FROM deg) AS avg_degree FROM deg ORDER BY degree DESC, src LIMIT 10")
def degree_topk(spark, sf_dir):
    """AGG-4."""
    return stats.degree_top(edges(spark, sf_dir))


@query(f"""WITH {LINKS}, notes AS (SELECT 'page' || page_id AS note FROM pages)
SELECT count(DISTINCT note) AS total_notes, (SELECT count(DISTINCT src) FROM edges SEMI JOIN notes ON src = note) AS notes_with_links, (SELECT count(*) // 2 FROM edges) AS total_edges FROM notes""")
def graph_stats(spark, sf_dir):
    """AGG-5."""
    notes = load(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("note"))
    return graph.totals(notes, edges(spark, sf_dir))


def _ppr(seeds: str) -> str:
    return f"""WITH RECURSIVE {LINKS}, out AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges),
seeds AS ({seeds}), restart AS (SELECT seed_set, node AS note, 1.0::DOUBLE / count(*) OVER (PARTITION BY seed_set) AS w FROM seeds),
s AS (
  SELECT 0 AS i, seed_set, note, w AS score FROM restart
  UNION ALL
  SELECT i, seed_set, note, sum(score) AS score FROM (
    SELECT s.i + 1 AS i, seed_set, dst AS note, 0.85 * score / degree AS score FROM s JOIN out ON s.note = out.src WHERE s.i < 30
    UNION ALL
    SELECT k.i + 1 AS i, r.seed_set, r.note, 0.15 * w FROM (SELECT DISTINCT i FROM s WHERE i < 30) k, restart r) GROUP BY i, seed_set, note),
final AS (SELECT seed_set, note, round(score, 9) AS score FROM s WHERE i = 30)"""


@query(_ppr("SELECT 0 AS seed_set, min(src) AS node FROM links") + " SELECT note, round(score, 6) AS score FROM final ANTI JOIN seeds ON note = node ORDER BY final.score DESC, note LIMIT 20")
def ppr_related(spark, sf_dir):
    """GRF-2, GRF-3, TOP-3."""
    e = edges(spark, sf_dir)
    seeds = links(spark, sf_dir).agg(F.min("src").alias("node")).select(F.lit(0).alias("seed_set"), "node")
    return graph.best(graph.personalized_pagerank(e, seeds), 20, drop=seeds).select("note", F.round("score", 6).alias("score"))


@query(_ppr("SELECT length(src) AS seed_set, src AS node FROM (SELECT DISTINCT src FROM links) QUALIFY row_number() OVER (PARTITION BY length(src) ORDER BY src) <= 5")
       + ", r AS (SELECT *, row_number() OVER (PARTITION BY seed_set ORDER BY score DESC, note) AS rank FROM final ANTI JOIN seeds ON note = node AND final.seed_set = seeds.seed_set) SELECT seed_set, note, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def ppr_expand(spark, sf_dir):
    """GRF-4 for one result list of each length of page name, in one run."""
    from pyspark.sql import Window

    lists = links(spark, sf_dir).select(F.col("src").alias("note")).distinct().withColumn("seed_set", F.length("note"))
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("seed_set").orderBy("note")) - 1).where(F.col("rank") < 5)
    return graph.expand(edges(spark, sf_dir), ranked).select("seed_set", "note", F.round("score", 6).alias("score"), "rank")


@query(_ppr("SELECT 0 AS seed_set, min(src) AS node FROM links") + " SELECT note, round(score, 6) AS score FROM final ANTI JOIN seeds ON note = node ORDER BY final.score DESC, note LIMIT 20")
def ppr_related_joined(spark, sf_dir):
    """GRF-2 by the join loop, as graphs above the kernel's size take it."""
    e = graph.staged(edges(spark, sf_dir))
    seeds = links(spark, sf_dir).agg(F.min("src").alias("node")).select(F.lit(0).alias("seed_set"), "node")
    return graph.best(graph.personalized_pagerank(e, seeds, kernel_edges=0), 20, drop=seeds).select("note", F.round("score", 6).alias("score"))


@query(f"""WITH {LINKS}, s AS (SELECT min(src) AS note FROM links),
h1 AS (SELECT DISTINCT dst AS note FROM edges JOIN s ON src = note), h2 AS (SELECT DISTINCT dst AS note FROM edges JOIN h1 ON src = note)
SELECT note, min(hop) AS hop FROM (SELECT note, 1 AS hop FROM h1 UNION ALL SELECT note, 2 FROM h2) WHERE note NOT IN (SELECT note FROM s) AND starts_with(note, 'page') GROUP BY note""")
def k_hop(spark, sf_dir):
    """GRF-5: pages within two links of the first."""
    notes = load(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("note"))
    start = links(spark, sf_dir).agg(F.min("src").alias("note"))
    return graph.k_hop(graph.staged(edges(spark, sf_dir)), start, 2, real=notes)


_SING = """CASE WHEN length(s) <= 3 THEN s WHEN s LIKE '%ies' AND NOT s LIKE '%series' THEN left(s, -3) || 'y' WHEN s LIKE '%ses' AND NOT s LIKE '%ases' THEN left(s, -2)
  WHEN s LIKE '%s' AND NOT (s LIKE '%ss' OR s LIKE '%us' OR s LIKE '%is') THEN left(s, -1) ELSE s END"""
_NORM = """regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^the ', ''), '^a ', ''), '^an ', ''), '\\s*\\([^)]*\\)\\s*$', '')), '\\s+', ' ', 'g')"""
_ABBR = "CASE {x} WHEN 'us' THEN 'ultrasound' WHEN 'ha' THEN 'hyaluronic acid' WHEN 'pe' THEN 'pulmonary embolism' WHEN 'ms' THEN 'multiple sclerosis' WHEN 'si' THEN 'sacroiliac' WHEN 'ct' THEN 'computed tomography' WHEN 'ra' THEN 'rheumatoid arthritis' WHEN 'oa' THEN 'osteoarthritis' WHEN 'cp' THEN 'cerebral palsy' ELSE {x} END"


def page_entities(spark, sf_dir) -> DataFrame:
    got = links(spark, sf_dir).select(F.col("src").alias("note"), F.col("dst").alias("name"))
    return got.withColumn("canonical", entities.normalise_entity(F.col("name")))


ENTITIES = f"""{LINKS}, raw AS (SELECT src AS note, dst AS name, {_NORM.format(x='dst')} AS n FROM links WHERE dst <> ''),
ab AS (SELECT note, name, {_ABBR.format(x='n')} AS s FROM raw), ents AS (SELECT note, name, {_SING} AS canonical FROM ab)"""


@query(f"WITH {ENTITIES} SELECT note, name, canonical FROM ents")
def entity_normalize(spark, sf_dir):
    """ENT-1."""
    return page_entities(spark, sf_dir)


@query(f"""WITH {ENTITIES}, p AS (SELECT DISTINCT note, canonical AS entity FROM ents WHERE length(canonical) >= 3 AND canonical NOT IN ('age', 'area', 'high', 'low', 'form', 'text'))
SELECT entity, list_sort(list(note)) AS notes FROM p GROUP BY entity HAVING count(*) BETWEEN 2 AND 50""")
def entity_bridges(spark, sf_dir):
    """AGG-7, ENT-7."""
    return entities.bridges(page_entities(spark, sf_dir))


@query(f"""WITH {ENTITIES}, own AS (SELECT DISTINCT canonical FROM ents WHERE note = 'page1')
SELECT note, list_sort(list(DISTINCT canonical)) AS shared_entities, count(DISTINCT canonical) AS count FROM ents SEMI JOIN own USING (canonical) WHERE note <> 'page1'
GROUP BY note HAVING count(DISTINCT canonical) >= 2 ORDER BY count DESC, note LIMIT 20""")
def bridges_for_note(spark, sf_dir):
    """JOIN-7, ENT-6, SET-3, TOP-4; the note's name is matched without regard to case."""
    return entities.bridges_for(page_entities(spark, sf_dir), "PAGE1")


@query(f"""WITH {ENTITIES}, k AS (SELECT note, name, canonical FROM ents WHERE length(name) >= 3 AND NOT regexp_matches(name, '^[\\d\\s.,%]+$') AND NOT regexp_matches(name, '^[#!]') AND length(canonical) >= 2
  AND canonical NOT IN ('age', 'area', 'high', 'low', 'form', 'text'))
SELECT note, min(name) AS name, 'condition' AS type, canonical FROM k GROUP BY note, canonical""")
def entity_filter(spark, sf_dir):
    """ENT-4."""
    return entities.filter_entities(page_entities(spark, sf_dir).select("note", "name"))


@query("SELECT CASE event_type WHEN 'view' THEN 'treats' WHEN 'click' THEN 'causes' WHEN 'error' THEN 'diagnoses' ELSE 'associated_with' END AS type, count(*) AS n FROM events GROUP BY 1")
def relation_histogram(spark, sf_dir):
    """ENT-2, AGG-3: event types under spellings of relations."""
    spell = F.when(F.col("event_type") == "view", " Treated_By ").when(F.col("event_type") == "click", "finding_causing").when(F.col("event_type") == "error", "ASSESSES").otherwise(F.col("event_type"))
    return stats.relation_histogram(load(spark, sf_dir, "events").select(spell.alias("type")))


def part_relations(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in (("SMALL", "treats"), ("LARGE", "symptom_of"), ("ECONOMY", "diagnoses")) for x in p])
    return load(spark, sf_dir, "part").select(F.col("p_name").alias("from"), F.col("p_type").alias("to"), F.coalesce(F.element_at(kinds, F.col("p_type")), F.lit("causes")).alias("type"), F.col("p_brand").alias("source_note"), "p_partkey")


@query("""WITH r AS (SELECT p_partkey, p_brand AS note, p_name AS a, p_type AS b, CASE p_type WHEN 'SMALL' THEN 'treats' WHEN 'LARGE' THEN 'symptom_of' WHEN 'ECONOMY' THEN 'diagnoses' ELSE 'causes' END AS t FROM part),
e AS (SELECT note, p_partkey, 0 AS k, a AS name, t FROM r UNION ALL SELECT note, p_partkey, 1, b, t FROM r),
n AS (SELECT *, lower(trim(name)) AS s FROM e),
c AS (SELECT *, CASE WHEN length(s) > 3 AND s LIKE '%s' AND NOT (s LIKE '%ss' OR s LIKE '%us' OR s LIKE '%is') THEN left(s, -1) ELSE s END AS canonical FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY note, canonical ORDER BY p_partkey, k, name) AS nth FROM c)
SELECT note, name, CASE t WHEN 'treats' THEN 'treatment' WHEN 'symptom_of' THEN 'symptom' WHEN 'diagnoses' THEN 'test' ELSE 'condition' END AS type, canonical FROM o WHERE nth = 1""")
def legacy_entities(spark, sf_dir):
    """ENT-3: both ends of the parts' relations."""
    return entities.entities_of_relations(part_relations(spark, sf_dir), order="p_partkey")


@query("SELECT note, count(*) AS n_entities FROM (SELECT DISTINCT p_brand AS note, p_name FROM part) GROUP BY note")
def entity_totals(spark, sf_dir):
    """AGG-6."""
    return stats.entity_totals(load(spark, sf_dir, "part").select(F.col("p_brand").alias("note"), "p_name").distinct())


@query(f"""WITH {ENTITIES}, n AS (SELECT note, row_number() OVER (ORDER BY note) - 1 AS rank FROM (SELECT DISTINCT note FROM ents)),
d AS (SELECT DISTINCT note, canonical FROM ents), r AS (SELECT d.note, canonical, rank, row_number() OVER (PARTITION BY d.note ORDER BY canonical) AS nth FROM d JOIN n USING (note) WHERE rank < 15)
SELECT note, rank, canonical, nth FROM r WHERE nth <= 10""")
def result_entities(spark, sf_dir):
    """JOIN-4: ten entities of each of the first fifteen notes."""
    from corvane.operators import scoring

    e = page_entities(spark, sf_dir).select("note", "canonical").distinct().withColumn("name", F.lit("")).withColumn("type", F.lit(""))
    return entities.entities_of(scoring.ranked(e.select("note").distinct().orderBy("note").limit(30), "note"), e).select("note", "rank", "canonical", "nth")


@query("""SELECT c_custkey AS id, 'primary' AS origin FROM customer WHERE c_acctbal > 0
UNION ALL SELECT DISTINCT o_custkey, 'fallback' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def merge_if_absent(spark, sf_dir):
    """SET-6: customers in credit, and of the orders' customers those that are not among them."""
    a = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("primary").alias("origin"))
    b = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("fallback").alias("origin")).distinct()
    return entities.merge_absent(a, b, "id")


# Change tracking: the state of customers at a first and a second scan. Between them the balance class of some changed,
# those of nation 7 went and those of nation 3 came.


def _scans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "customer")
    file = F.col("c_name").alias("file")
    then = c.where("c_nationkey != 3").select(file, changes.content_hash(F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("hash"))
    seg = F.when(F.col("c_nationkey") == 5, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    now = c.where("c_nationkey != 7").select(file, changes.content_hash(F.concat_ws("|", seg, F.col("c_nationkey").cast("string"))).alias("hash"))
    return now, then


SCANS = """then_ AS (SELECT c_name AS file, sha256(c_mktsegment || '|' || c_nationkey) AS hash FROM customer WHERE c_nationkey <> 3),
now_ AS (SELECT c_name AS file, sha256(CASE WHEN c_nationkey = 5 THEN lower(c_mktsegment) ELSE c_mktsegment END || '|' || c_nationkey) AS hash FROM customer WHERE c_nationkey <> 7)"""


@query(f"""WITH {SCANS} SELECT coalesce(n.file, t.file) AS file, CASE WHEN t.file IS NULL THEN 'new' WHEN n.file IS NULL THEN 'gone' WHEN n.hash = t.hash THEN 'unchanged' ELSE 'modified' END AS state
FROM now_ n FULL JOIN then_ t ON n.file = t.file""")
def change_detection(spark, sf_dir):
    """JOIN-8, SCL-6."""
    now, then = _scans(spark, sf_dir)
    return changes.detect(now, then).select("file", "state")


@query(f"WITH {SCANS} SELECT file FROM then_ ANTI JOIN now_ USING (file)")
def orphans(spark, sf_dir):
    """JOIN-9, SET-1."""
    now, then = _scans(spark, sf_dir)
    return changes.orphans(then, now)


@query(f"WITH {SCANS} SELECT file, hash FROM then_ SEMI JOIN now_ USING (file)")
def orphan_prune(spark, sf_dir):
    """SNK-5."""
    now, then = _scans(spark, sf_dir)
    return changes.prune(then, now)


@query(f"WITH {SCANS} SELECT file, hash FROM then_ ANTI JOIN now_ USING (file) UNION ALL SELECT file, hash FROM now_")
def upsert_snapshot(spark, sf_dir):
    """SNK-3, SNK-4, through a snapshot table: written, upserted and read again."""
    from corvane.sources.snapshots import SnapshotTable

    now, then = _scans(spark, sf_dir)
    import uuid

    t = SnapshotTable(spark, f"{shared_folder(spark)}/corvane-snapshot-{uuid.uuid4().hex}")
    t.overwrite(then)
    t.upsert(now)
    t.purge()
    return t.read()


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE p.note IS NULL) AS fresh, count(*) FILTER (WHERE n.mtime > p.mtime) AS modified, count(*) FILTER (WHERE p.note IS NULL OR n.mtime > p.mtime) AS pending
FROM (SELECT c_custkey AS note, c_acctbal AS mtime FROM customer) n LEFT JOIN (SELECT o_custkey AS note, min(o_totalprice) / 10 AS mtime FROM orders GROUP BY o_custkey) p USING (note)""")
def pending_counts(spark, sf_dir):
    """AGG-11."""
    notes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"), F.col("c_acctbal").alias("mtime"))
    done = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("note")).agg((F.min("o_totalprice") / 10).alias("mtime"))
    return changes.pending(notes, done)


@query("""SELECT s_suppkey AS note, CASE WHEN s_acctbal < 0 THEN 0 WHEN s_nationkey IN (1, 2) THEN 1 ELSE 2 END AS bucket FROM supplier ORDER BY bucket, s_acctbal DESC, s_suppkey LIMIT 50""")
def extraction_order(spark, sf_dir):
    """TOP-6."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("note"), F.col("s_nationkey").cast("string").alias("folder"), F.col("s_acctbal").alias("mtime"), (F.col("s_acctbal") < 0).alias("redo"))
    return changes.extraction_order(s, ["1", "2"], 50).select("note", "bucket")


@query(f"""WITH {SCANS}, s AS (SELECT coalesce(n.file, t.file) AS file, CASE WHEN t.file IS NULL THEN 'new' WHEN n.file IS NULL THEN 'gone' WHEN n.hash = t.hash THEN 'unchanged' ELSE 'modified' END AS state FROM now_ n FULL JOIN then_ t ON n.file = t.file),
f AS (SELECT state, c_acctbal > -900 AS ok, c_nationkey AS n_chunks FROM s JOIN customer ON c_name = file)
SELECT count(*) FILTER (WHERE state IN ('new', 'modified') AND ok) AS processed, count(*) FILTER (WHERE state = 'unchanged') AS skipped, count(*) FILTER (WHERE NOT ok) AS errors,
  count(*) FILTER (WHERE state IN ('new', 'modified') AND ok AND n_chunks = 0) AS short, coalesce(sum(n_chunks) FILTER (WHERE state IN ('new', 'modified') AND ok), 0)::BIGINT AS chunks FROM f""")
def run_counters(spark, sf_dir):
    """AGG-13."""
    now, then = _scans(spark, sf_dir)
    c = load(spark, sf_dir, "customer").select(F.col("c_name").alias("file"), (F.col("c_acctbal") > -900).alias("ok"), F.col("c_nationkey").cast("long").alias("n_chunks"))
    return stats.run_counters(changes.detect(now, then).join(c, "file"))
