"""The query surface on a small corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, context, vector
from corvane.plans import api

NOW = 1_700_000_000.0


@pytest.fixture(scope="module")
def corpus(spark):
    words = "knee gait pain brace walk spine nerve hand foot splint".split()
    notes = []
    for i in range(24):
        body = "\n".join(f"# {words[(i + k) % 10]} part {k}\n" + " ".join([words[(i + k) % 10], words[(i * 3 + k) % 10]] * 8) for k in range(2))
        notes.append((f"f{i % 3}/n{i}.md", f"n{i}", f"f{i % 3}", NOW - i * 86400.0 * 40, body + f"\n[[n{(i + 1) % 24}]] [[n{(i * 5) % 24}|x]]"))
    df = spark.createDataFrame(notes, "file string, note string, folder string, mtime double, content string")
    embed = lambda d: vector.embed_batches(d, vector.hashing_embedder(64)).cache()
    chunks = embed(chunking.note_chunks(df))
    long = df.select(F.concat(F.lit("Book"), (F.col("mtime") % 2).cast("int").cast("string"), F.lit("/"), "note", F.lit(".md")).alias("file"), F.col("content"), "mtime")
    parents = chunking.longform_parents(long).cache()
    children = embed(chunking.longform_children(parents))
    from corvane.operators import graph

    edges = graph.symmetric(graph.note_links(df)).cache()
    query = list(vector.hashing_embedder(64)(__import__("pandas").Series(["gait and walk"])).iloc[0])
    return df, chunks, parents, children, edges, query


def test_search(corpus, spark):
    df, chunks, *_, edges, query = corpus
    rows = api.search(chunks, query, 5, now=NOW).collect()
    assert len(rows) == 5 and len({r.note for r in rows}) == 5 and [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)
    assert all(r.folder == "f1" for r in api.search(chunks, query, 5, now=NOW, folder="f1").collect())
    assert all(r.folder != "f2" for r in api.search(chunks, query, 5, now=NOW, profile=api.Profile(fetch="tool", exclude=["F2"])).collect())
    heavy = api.search(chunks, query, 5, now=NOW, profile=api.Profile(path_weights={"f0": 3.0})).collect()
    assert heavy[0].folder == "f0"
    rel = spark.createDataFrame([(rows[-1].note, "treats")], "source_note string, type string")
    boosted = {r.note: r.relation_weight for r in api.search(chunks, query, 5, now=NOW, query_text="treat it", relations=rel).collect()}
    assert boosted.get(rows[-1].note, 1.15) == 1.15
    more = api.search_expanded(api.search(chunks, query, 5, now=NOW), edges).collect()
    assert len(more) <= 10 and not {r.note for r in more} & {r.note for r in rows}
    with pytest.raises(ValueError):
        api.search(chunks, query, 31, now=NOW)
    assert api.checked(99, 30, clamp=True) == 30


def test_related_and_similar(corpus):
    df, chunks, _, _, edges, _ = corpus
    rel = api.related(edges, df, "n3", 5).orderBy("rank").collect()
    assert len(rel) == 5 and all(r.file for r in rel) and "n3" not in {r.note for r in rel} and rel[0].score >= rel[-1].score
    assert api.related(edges, df, "n3", 5, existing_only=True).count() == 5
    sim = api.similar(chunks, edges, "n3", 6, now=NOW).collect()
    assert len(sim) == 6 and "n3" not in {r.note for r in sim} and all(r.raw_similarity <= 2 / 60 for r in sim)
    assert api.similar(chunks, edges, "nowhere", 6, now=NOW).count() == 0


def test_longform_and_context(corpus):
    df, chunks, parents, children, _, query = corpus
    rows = api.longform_search(children, parents, query, 8).collect()
    assert rows and all(r.parent_text and not r.truncated for r in rows) and max(r.budget for r in rows) == 4000
    flat = api.longform_search(children, parents, query, 8, full_parent=False, profile=api.Profile(fetch="longform", source_boost={"Book0": 0.5})).collect()
    assert {r.budget for r in flat} == {800} and flat[0].book == "Book0"
    assert all(r.book == "Book1" for r in api.longform_search(children, parents, query, 8, book="Book1").collect())
    log = api.log_row(api.longform_search(children, parents, query, 8), query="q", raw=vector.top_k(children, query, 80)).first()
    assert log.query == "q" and 0 < log.unique_parent_ratio <= 1
    hit = api.longform_hits(children, query, 5, boost={"Book0": 0.3}).withColumn("page_start", F.lit(2)).select("file", "page_start").first()
    lines = children.select("file").distinct().where(F.col("file") == hit.file).select("file", F.explode(F.array(*[F.struct(F.lit(k).alias("page"), F.lit(k).alias("line_no"), F.lit(f"page {k}").alias("line")) for k in (1, 2, 3, 9)])).alias("l")).select("file", "l.*")
    wide = api.longform_hits(children.withColumn("page_start", F.lit(2)), query, 5, boost={"Book0": 0.3}, pages=lines).collect()
    assert wide and {r.text for r in wide if r.file == hit.file} == {"[p.1] page 1\n\n[p.2] page 2\n\n[p.3] page 3"} and all("gait" in r.text or "part" in r.text for r in wide if r.file != hit.file)
    text = api.chat_context(chunks, children, query, 3, now=NOW).first().context
    assert text is None or text == "" or "【" in text
    assert context.render_longform(api.longform_search(children, parents, query, 3)).first().markdown.startswith("### 1. Book")
