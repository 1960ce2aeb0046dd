"""Queries of corpora on disk and of contexts: scans, snapshot histories, full notes, the long-form half, extraction; with their DuckDB forms."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import changes, context, dedup, entities, vector
from corvane.plans import api
from corvane.plans.retrieval import CHUNKS, NEAR, NOW, ONE, chunks, load
from corvane.sources import markdown, snapshots
from corvane.sources.staging import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_texts(hits: DataFrame, spark, sf_dir) -> DataFrame:
    """A result list with the texts of the documents of the same ids."""
    return hits.join(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "left")


_LONG_WORD = re.compile("x?[a-zéèßü]{9,}[^\\W\\ds_]")


def example(spark, sf_dir) -> list[float]:
    return list(chunks(spark, sf_dir).orderBy("id").first().vector)


@query("""WITH f AS (SELECT DISTINCT source, lang FROM documents),
s AS (SELECT source, string_agg(lang, chr(10) ORDER BY lang) AS body FROM f GROUP BY source),
a AS (SELECT source || '/a b/n+' || source || '.md' AS file, 'n+' || source AS note, source AS folder, '# ' || source || chr(10) || 'é ' || body AS content FROM s UNION ALL SELECT source || '.md', source, '', 'top' FROM s)
SELECT file, note, folder, content, true AS ok, content AS lossy FROM a UNION ALL SELECT 'bad/x.md', 'x', 'bad', NULL, false, 'a' || chr(65533) || 'b'""")
def markdown_scan(spark, sf_dir):
    """SRC-1..4: a file for each source in a folder with a space, one at the top, an ill-formed one; hidden, listed and other files are not seen."""
    root = f"{shared_folder(spark)}/corvane-notes-{uuid.uuid4().hex}"
    per = load(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "\n").alias("body"))
    files = {"bad/x.md": b"a\xffb", ".git/x.md": b"no", "y/node_modules/x.md": b"no", "y/x.txt": b"no"}
    for r in per.collect():  # a row for each source
        files[f"{r.source}/a b/n+{r.source}.md"] = f"# {r.source}\né {r.body}".encode()
        files[f"{r.source}.md"] = b"top"
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, data in files.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
        out.write(bytearray(data))
        out.close()
    strict, lossy = markdown.scan(spark, root), markdown.scan(spark, root, lossy=True)
    return strict.drop("mtime").join(lossy.select("file", F.col("content").alias("lossy")), "file").select("file", "note", "folder", "content", "ok", "lossy")


@query("""WITH c AS (SELECT c_custkey AS id, 'n' || c_nationkey || CASE WHEN c_nationkey % 2 = 0 THEN chr(39) || 's.md' ELSE '.md' END AS file, c_nationkey AS k FROM customer)
SELECT id, file, CASE WHEN k IN (3, 4, 5) THEN 2 WHEN k >= 20 THEN 1 ELSE 0 END AS v FROM c WHERE k NOT IN (6, 7, 8) AND k < 23 AND NOT (k = 9 AND id % 2 = 1)""")
def snapshot_history(spark, sf_dir):
    """SNK-1..7, SNK-11, SRC-6, SRC-7: rebuilt, appended to, upserted, deleted from (names with quotes), pruned, compacted, purged and marked."""
    k, name = F.col("c_nationkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "'s.md").otherwise(".md"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("file"), k.alias("k"))
    rows = lambda where, v: c.where(where).select("id", "file", F.lit(v).alias("v"))
    t = snapshots.SnapshotTable(spark, f"{shared_folder(spark)}/corvane-history-{uuid.uuid4().hex}")
    t.overwrite(rows("k < 20", 9))
    t.overwrite(rows("k < 20", 0))
    t.append(rows("k >= 20", 1))
    t.upsert(rows("k IN (3, 4, 5)", 2))
    t.upsert(rows("k = 9 AND id % 2 = 0", 0), touched=c.where("k = 9").select("file"))
    t.delete(c.where("k IN (6, 7, 8)").select("file"))
    t.prune(c.where("k < 23").select("file"))
    before = t.count()
    t.compact()
    t.purge()
    t.mark_ready(snapshots.signature(rows="customer"))
    assert len(t.versions()) == 1 and t.count() == before
    return t.read(["id", "file", "v"])


@query("SELECT n_nationkey AS k, n_name AS name, n_nationkey % 3 = 0 AS flag FROM nation")
def state_file(spark, sf_dir):
    """SNK-8, SRC-8: state saved as JSON, and over itself, then read."""
    path = f"{shared_folder(spark)}/corvane-state-{uuid.uuid4().hex}"
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 0).alias("flag"))
    snapshots.save_state(n.where("k < 5"), path, as_json=True)
    snapshots.save_state(n, path, as_json=True)
    return spark.read.schema("k INT, name STRING, flag BOOLEAN").json(path)


@query("""WITH d AS (SELECT *, ts::DATE AS day, dense_rank() OVER (ORDER BY ts::DATE DESC) AS r FROM events) SELECT event_id, event_type AS query FROM d WHERE r <= 3""")
def query_log(spark, sf_dir):
    """SNK-9: a log row for each event, of which the last three days are kept."""
    path = f"{shared_folder(spark)}/corvane-log-{uuid.uuid4().hex}"
    snapshots.append_log(load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("query")), path)
    snapshots.rotate_log(spark, path, 3)
    return spark.read.json(path).select("event_id", "query")


@query("""WITH n AS (SELECT source || '/d' || doc_id || '.md' AS file, text FROM documents),
w AS (SELECT CASE doc_id % 3 WHEN 0 THEN source || '/d' || doc_id WHEN 1 THEN source || '/d' || doc_id || '.md' ELSE 'gone/d' || doc_id END AS path FROM documents)
SELECT path, coalesce(a.text, b.text, '') AS content FROM w LEFT JOIN n a ON a.file = path LEFT JOIN n b ON b.file = path || '.md'""")
def full_notes(spark, sf_dir):
    """CTX-1: notes by their path, by the path without its ending, and some that are not there."""
    d, k = load(spark, sf_dir, "documents"), F.col("doc_id")
    stem = F.concat("source", F.lit("/d"), k.cast("string"))
    wanted = d.select(F.when(k % 3 == 0, stem).when(k % 3 == 1, F.concat(stem, F.lit(".md"))).otherwise(F.concat(F.lit("gone/d"), k.cast("string"))).alias("path"))
    return context.full_notes(wanted, d.select(F.concat(stem, F.lit(".md")).alias("file"), F.col("text").alias("content")))


@query("""SELECT vec_id AS id, vec_id * 3 AS parent_id, coalesce(text, '') AS parent_full, coalesce(n_chars, 0) AS parent_tokens FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3""")
def child_parents(spark, sf_dir):
    """JOIN-1: every vector as the child of the document of three times its id, where there is one."""
    kids = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3).alias("parent_id"))
    return context.with_parents(kids, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text", F.col("n_chars").alias("token_count"))).select("id", "parent_id", "parent_full", "parent_tokens")


BLOCK = "'】(sim=' || printf('%.2f', s) || ')' || chr(10) || CASE WHEN length(text) > {cut} THEN left(text, {cut}) || '...' ELSE coalesce(text, '') END"


@query(f"""WITH {ONE},{CHUNKS},{NEAR},
hits AS (SELECT * FROM near ORDER BY d12, id LIMIT 24),
first AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY d12, id) AS nth FROM hits),
w AS (
  SELECT *, round(similarity * CASE folder WHEN 'f1' THEN 1.2 WHEN 'f2' THEN 0.8 ELSE 1.0 END * greatest(0.7, 1 / (1 + ln(1 + greatest(0, ({NOW} - mtime) / 86400) / 365) * 0.3)), 4) AS s FROM first WHERE nth = 1),
top AS (SELECT *, row_number() OVER (ORDER BY s DESC, d12, id) AS r FROM w QUALIFY r <= 8)
SELECT string_agg('【' || note || ' › ' || folder || {BLOCK.format(cut=1500)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context
FROM top LEFT JOIN documents ON doc_id = id WHERE s >= 0.1""")
def rag_context(spark, sf_dir):
    """CTX-3, FLT-5: the blocks of a search's results (its floor set to 0.1, as the vectors are far apart)."""
    hits = api.search(chunks(spark, sf_dir), example(spark, sf_dir), 8, now=NOW, profile=api.Profile(path_weights={"f1": 1.2, "f2": 0.8}))
    return context.join_blocks(context.rag_blocks(with_texts(context.floor(hits, 0.1).withColumn("section", F.col("folder")), spark, sf_dir), cut=1500))


LONG = f"""{ONE},{CHUNKS},{NEAR},
hits AS (SELECT *, round(similarity + CASE folder WHEN 'f3' THEN 0.45 WHEN 'f4' THEN 0.4 WHEN 'f5' THEN -0.1 ELSE 0 END, 4) AS s FROM (SELECT * FROM near ORDER BY d12, id LIMIT 40)),
two AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY s DESC, d12, id) AS nth FROM hits WHERE s >= 0.5 QUALIFY nth <= 2),
top AS (SELECT *, row_number() OVER (ORDER BY s DESC, d12, id) - 1 AS rank FROM two QUALIFY rank < 8)"""


@query(f"WITH {LONG} SELECT rank, id, folder AS book, s AS similarity FROM top")
def longform_hits(spark, sf_dir):
    """KNN-3, SCR-5, FLT-5, WIN-4: what the long-form half of a context is made of."""
    return _longform(spark, sf_dir).select("rank", "id", "book", "similarity")


def _longform(spark, sf_dir) -> DataFrame:
    kids = chunks(spark, sf_dir).withColumn("book", F.col("folder"))
    return api.longform_hits(kids, example(spark, sf_dir), 8, boost={"f3": 0.45, "f4": 0.4, "f5": -0.1})


@query(f"""WITH {LONG} SELECT string_agg('【📖 ' || folder || ' › ' || folder || '/' || note || '.md' || ' › ' || note || {BLOCK.format(cut=3000)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM top LEFT JOIN documents ON doc_id = id""")
def longform_context(spark, sf_dir):
    """CTX-4: their blocks in one text."""
    return context.join_blocks(context.rag_blocks(with_texts(_longform(spark, sf_dir), spark, sf_dir).withColumn("section", F.col("note")), cut=3000, longform=True))


@query("""WITH p(profile) AS (VALUES ('api'), ('tool'), ('longform'), ('similar'), ('chat'), ('chat_longform')), n AS (SELECT DISTINCT p_size AS n FROM part)
SELECT profile, n, CASE profile WHEN 'tool' THEN least(5 * n, 100) WHEN 'longform' THEN 10 * n WHEN 'similar' THEN greatest(3 * n, 40) WHEN 'chat_longform' THEN 5 * greatest(5, n) ELSE 3 * n END AS rows FROM p, n""")
def over_fetch_policy(spark, sf_dir):
    """KNN-3: rows fetched for each profile and number of results."""
    sizes = [r[0] for r in load(spark, sf_dir, "part").select("p_size").distinct().collect()]  # 1..50
    return spark.createDataFrame([(p, n, vector.over_fetch(p, n)) for p in ("api", "tool", "longform", "similar", "chat", "chat_longform") for n in sizes], "profile string, n int, rows int")


@query("""WITH h AS (SELECT doc_id, left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)), 10000) AS body FROM documents),
f AS (SELECT doc_id, unnest(regexp_extract_all(body, 'x?[a-zéèßü]{9,}[^s\\PL]')) AS name FROM h)
SELECT DISTINCT 'd' || doc_id AS note, name, 'condition' AS type, name AS canonical FROM f WHERE NOT ends_with(name, 's')""")
def entity_batch(spark, sf_dir):
    """ENT-5 with a pattern for a recogniser: long words in lower case that do not end in s."""
    find = lambda texts: texts.map(lambda t: [w for w in _LONG_WORD.findall(t or "") if not w.endswith("s")])

    def extractor(texts: pd.Series) -> pd.Series:
        return find(texts)

    notes = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note"), F.col("text").alias("content"))
    return entities.extract_entities(notes, extractor)


@query("""WITH old AS (SELECT event_id, user_id, event_type AS type FROM events WHERE event_id % 2 = 0), new AS (SELECT event_id, user_id, 'found_' || event_type AS type FROM events WHERE user_id % 5 = 0 AND event_id % 3 = 0)
SELECT 'n' || user_id AS source_note, type, event_id FROM old WHERE user_id % 5 <> 0 UNION ALL SELECT 'n' || user_id, type, event_id FROM new""")
def relation_refresh(spark, sf_dir):
    """ENT-9: relations of the notes that were extracted anew take the place of their old ones, also where nothing was found."""
    e = load(spark, sf_dir, "events").withColumn("source_note", F.concat(F.lit("n"), F.col("user_id").cast("string")))
    old = e.where("event_id % 2 = 0").select("source_note", F.col("event_type").alias("type"), "event_id")
    new = e.where("user_id % 5 = 0 AND event_id % 3 = 0").select("source_note", F.concat(F.lit("found_"), "event_type").alias("type"), "event_id")
    return entities.replace_for(old, new, e.where("user_id % 5 = 0").select("source_note").distinct())


@query("""WITH f AS (SELECT 'extra/' || CASE WHEN s_suppkey = 1 THEN 'MEMORY' ELSE s_name END || '.md' AS file, CASE WHEN s_suppkey = 1 THEN 'MEMORY' ELSE s_name END AS stem, s_acctbal AS mtime, s_suppkey FROM supplier)
SELECT 'memory:' || stem AS note, file, mtime, 'memory' AS folder FROM f WHERE stem <> 'MEMORY' AND mtime > CASE WHEN s_suppkey % 2 = 0 THEN 1000.0 ELSE 0.0 END""")
def supplementary_files(spark, sf_dir):
    """ENT-10: files new, or later than when they were processed."""
    s = load(spark, sf_dir, "supplier").withColumn("stem", F.when(F.col("s_suppkey") == 1, "MEMORY").otherwise(F.col("s_name")))
    files = s.select(F.concat(F.lit("extra/"), "stem", F.lit(".md")).alias("file"), F.col("s_acctbal").alias("mtime"))
    done = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("memory:"), "stem").alias("note"), F.lit(1000.0).alias("mtime"))
    return changes.supplementary(files, done)


@query("SELECT source, any_value(lang ORDER BY doc_id) AS lang, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_of_each(spark, sf_dir):
    """SET-5: of repeated keys the first in order stays."""
    d = load(spark, sf_dir, "documents")
    return dedup.keep_first(d.select("source", "lang", "doc_id"), "source", "doc_id")
