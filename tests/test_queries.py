"""Every query that has SQL agrees with it; the others run."""

from __future__ import annotations

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector
from corvane.plans import registry
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="the driver's tables are not here")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA / "sf0.001")).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_every_row_is_a_query(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[41] = x[7]  # a tie
    c = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, vector array<float>").repartition(3)
    y = x.astype(np.float64)
    d = np.round(1 - (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1)), 12)
    want = {(q, int(i), r + 1) for q in range(60) for r, i in enumerate(np.lexsort((np.arange(60), d[q]))[:5])}
    q = c.select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    assert {(r.qid, r.id, r["rank"]) for r in vector.top_k_many(c, q, 5).collect()} == want
    monkeypatch.setattr(vector, "CELLS", 50)
    parts = vector.top_k_many(c, q, 5, max_broadcast=13)
    assert {(r.qid, r.id, r["rank"]) for r in parts.collect()} == want


def test_ingest_has_files_by_the_input(spark, monkeypatch):
    from corvane.plans import texts

    seen, stream = [], texts.ingest.note_stream

    def note_stream(spark, folder, *, files_per_batch):
        seen.append((sum(f > 0 for (f,) in spark.read.parquet(folder).groupBy(F.input_file_name()).count().select("count").collect()), files_per_batch))
        return stream(spark, folder, files_per_batch=files_per_batch)

    monkeypatch.setattr(texts.ingest, "note_stream", note_stream)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        compare(spark, "ingest_stream", registry.queries()["ingest_stream"], SQL["ingest_stream"])
        parts = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 4 and seen == [(parts, -(-3 * parts // 4))] * 2


def text_with(sums: dict[int, int]) -> str:
    """A text that, with the instruction before it, has these sums of word signs in the 32 places and 0 in the others."""

    def place(w):
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
        return h % 32, 1 if h >> 63 else -1

    word = {}
    for w in map("w{}".format, itertools.count()):
        word.setdefault(place(w), w)
        if len(word) == 64:
            break
    need = dict.fromkeys(range(32), 0) | sums
    for b, sign in map(place, re.findall(r"\w+", vector.LONGFORM_INSTRUCTION.lower())):
        need[b] -= sign
    return " ".join(w for b, n in need.items() for w in [word[b, 1 if n > 0 else -1]] * abs(n))


def test_embedding_rounds_once(spark, tmp_path):
    # 3 / sqrt(281) = 0.178964996, as a float above the middle of 0.17896 and 0.17897; 23 / 320 = 0.071875 is a middle itself
    texts = [text_with({0: 3, 1: 16, 2: -4}), text_with({0: 23, 1: 41, 2: -51, 3: 312, 4: 14, 5: -7})]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
        c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
        want = {r[0]: r[1] for r in c.execute(SQL["embed_documents"]).fetchall()}
    got = {r.doc_id: r.vector for r in registry.queries()["embed_documents"](spark, str(tmp_path)).collect()}
    assert got == want and got[0][:3] == [0.17896, 0.95448, -0.23862] and got[1][0] == 0.07187


def agrees(spark, folder, table, frame, name):
    """The query on a table of its own is what its SQL is on it."""
    frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        want = c.execute(SQL[name]).fetchall()
    assert sorted(map(tuple, registry.queries()[name](spark, str(folder)).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["render_longform", "render_results"])
def test_rendered_similarities(spark, tmp_path, name):
    # the first vector's similarities to the others are 0.0050, 0.0150, ... 0.2350
    rows = [(0, [1.0, 0.0], 0)] + [(i + 1, [s, (1 - s * s) ** 0.5], i % 3) for i, s in enumerate((k * 100 + 50) / 10_000 for k in range(24))]
    agrees(spark, tmp_path, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), name)


BLANKS = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2003\u200b\u2028\u202f\u205f\u3000\ufeff"
ENDS = [None, "", " ", "---", "x", *BLANKS, *[f"{b}a{b}\n{b}é---{b}" for b in BLANKS], "\n" + "é\U0001f600 " * 300, "w" * 799 + "  ", "v" * 800, " " * 900]


@pytest.mark.parametrize("name", ["excerpt", "section_path_nfkc"])
def test_texts_with_blank_ends(spark, tmp_path, name):
    more = ["ﬁ ½ Ａ", "e\u0301 \u212b", "\u0301e"] if name == "section_path_nfkc" else []
    agrees(spark, tmp_path, "documents", spark.createDataFrame(list(enumerate(ENDS + more)), "doc_id long, text string"), name)
