"""Operators on small hand-written inputs, against plain Python."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions import vocabulary
from corvane.operators import batches, chunking, context, dedup, entities, graph, scoring, vector
from corvane.sources import markdown, snapshots


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("x")).first()[0]


# --- file selection: the shapes of books

SHAPES = [
    ("split", ["B/full_text.md", "B/ch01_a.md", "B/ch02_b.md"], {}, {"B/ch01_a.md", "B/ch02_b.md"}),
    ("unsplit", ["B/full_text.md", "B/INDEX.md"], {}, {"B/full_text.md"}),
    ("mixed", ["S/full_text.md", "S/ch01_a.md", "U/full_text.md"], {}, {"S/ch01_a.md", "U/full_text.md"}),
    ("index alone", ["B/INDEX.md"], {}, set()),
    ("guard", ["B/full_text.md"], {"skip": ("INDEX.md", "full_text.md")}, {"B/full_text.md"}),
    ("skip holds", ["B/full_text.md", "B/ch01_a.md"], {"skip": ("INDEX.md", "full_text.md")}, {"B/ch01_a.md"}),
    ("no whole names", ["B/full_text.md", "B/ch01_a.md"], {"whole": ()}, {"B/full_text.md", "B/ch01_a.md"}),
    ("pycache", ["B/ch01_a.md", "B/__pycache__/junk.md"], {}, {"B/ch01_a.md"}),
    ("readme beside", ["B/full_text.md", "B/README.md"], {}, {"B/full_text.md", "B/README.md"}),
    ("index by case", ["B/full_text.md", "B/Index.md"], {}, {"B/full_text.md"}),
    ("whole by case", ["B/FULL_TEXT.md", "B/ch01_a.md"], {}, {"B/ch01_a.md"}),
    ("readme stays", ["B/full_text.md", "B/ch01_a.md", "B/README.md"], {}, {"B/ch01_a.md", "B/README.md"}),
    ("numbers", ["B/full_text.md", "B/05_Imaging.md", "B/06_Gait.md"], {}, {"B/05_Imaging.md", "B/06_Gait.md"}),
    ("pages", ["B/full_text.md", "B/pages_0001-0030.md", "B/pages_0031-0060.md"], {}, {"B/pages_0001-0030.md", "B/pages_0031-0060.md"}),
    ("other names", ["B/full_text.md", "B/Introduction.md"], {}, {"B/full_text.md", "B/Introduction.md"}),
    ("own pattern", ["B/full_text.md", "B/part-a.md", "B/part-b.md"], {"chapter": "^part-"}, {"B/part-a.md", "B/part-b.md"}),
    ("volumes", ["B/V1/full_text.md", "B/V1/ch01_a.md", "B/V2/full_text.md"], {}, {"B/V1/ch01_a.md", "B/V2/full_text.md"}),
]


@pytest.mark.parametrize(("paths", "options", "kept"), [s[1:] for s in SHAPES], ids=[s[0] for s in SHAPES])
def test_file_selection(spark, paths, options, kept):
    out = markdown.select_files(spark.createDataFrame([(p,) for p in paths], "path string"), **options)
    assert {r.path for r in out.where("kept").collect()} == kept


def test_scan(spark, tmp_path):
    for name, data in {"a b/n1.md": "x".encode(), "top.md": "é".encode(), "a/bad.md": b"\xff\xfe", ".hidden/n.md": b"h", "templates/t.md": b"t", "a/x.txt": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    rows = {r.file: r for r in markdown.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b/n1.md", "top.md", "a/bad.md"}
    assert rows["a b/n1.md"].note == "n1" and rows["a b/n1.md"].folder == "a b" and rows["top.md"].folder == "" and not rows["a/bad.md"].ok
    assert {r.file: r.content for r in markdown.scan(spark, str(tmp_path), lossy=True).collect()}["a/bad.md"].count("�") >= 1


# --- snapshots


def test_snapshots(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    row = lambda f, v: [(f"{f}{i}", f, v) for i in range(3)]
    make = lambda rows: spark.createDataFrame(rows, "id string, file string, v int")
    for f in "a.md b.md it's.md d.md e.md".split():
        t.append(make(row(f, 0)))
    for v in range(1, 5):
        t.upsert(make(row("a.md", v)))
    assert t.count() == 15 and t.read().where("file = 'a.md' AND v = 4").count() == 3
    assert t.purge(keep=2) == 6 and len(t.versions()) == 3
    before = len(t.versions())
    t.delete(spark.createDataFrame([("a.md",), ("b.md",), ("it's.md",), ("d.md",)], "file string"))
    assert len(t.versions()) == before + 1 and {r.file for r in t.read(["file"]).collect()} == {"e.md"}
    t.upsert(make([]), touched=spark.createDataFrame([("e.md",)], "file string"))  # a note that lost all its chunks
    assert t.count() == 0
    assert t.mark_ready("abc").startswith("READY.abc_")
    sig = snapshots.signature(a=1, b="x")
    assert sig == snapshots.signature(b="x", a=1) and len(sig) == 16
    with pytest.raises(ValueError):
        snapshots.check_signature(make([("1", "f", 1)]).withColumn("indexing_signature", F.lit("other")), sig)


def test_a_change_writes_what_changed(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    rows = {f"f{k}": 0 for k in range(400)}
    make = lambda d: spark.createDataFrame([(f, v) for f, v in d.items()], "file string, v int")
    t.overwrite(make(rows))
    base, most, written = t.segments()[0]["data"], 0, 0
    for k in range(1, 25):
        part = {f"f{(7 * k + i) % 410}": k for i in range(3)}
        rows |= part
        t.upsert(make(part))
        if k % 6 == 0:
            gone = f"f{k}"
            rows.pop(gone, None)
            t.delete(spark.createDataFrame([(gone,)], "file string"))
        segments = t.segments()
        most, written = max(most, len(segments)), written + segments[-1]["rows"]
        if k < 10:
            assert segments[0]["data"] == base  # the large segment is not rewritten for small changes
    assert dict(tuple(r) for r in t.read().collect()) == rows and most <= 5 and written < 3000
    t.prune(spark.createDataFrame([("f5",), ("f6",)], "file string"))
    assert {r.file for r in t.read(["file"]).collect()} == {"f5", "f6"} & set(rows)
    t.compact()
    assert len(t.segments()) == 1 and t.purge() > 0 and {r.file for r in t.read().collect()} == {"f5", "f6"} & set(rows)


def test_two_writers_and_old_versions(spark, tmp_path):
    a, b = (snapshots.SnapshotTable(spark, str(tmp_path / "t")) for _ in range(2))
    make = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    first = a.append(make("x"))
    plain, raced = a.current, []

    def late():  # another writer comes in between
        now = plain()
        if not raced:
            raced.append(b.append(make("y")))
        return now

    a.current = late
    a.append(make("z"))
    assert {r.file for r in b.read().collect()} == {"x", "y", "z"} and len(b.versions()) == 3
    assert [r.file for r in b.read(version=first).collect()] == ["x"]
    with pytest.raises(FileNotFoundError):
        snapshots.SnapshotTable(spark, str(tmp_path / "none")).read()


def test_log_rotation(spark, tmp_path):
    for day in (1, 2, 3):
        snapshots.append_log(spark.createDataFrame([(f"2024-01-0{day} 10:00:00", "q")], "ts string, query string"), str(tmp_path / "log"))
    assert snapshots.rotate_log(spark, str(tmp_path / "log"), 2) == 1
    assert spark.read.json(str(tmp_path / "log")).count() == 2


# --- text functions


def test_text_functions(spark):
    s = lambda e, v: one(spark, e(F.col("c")), c=v)
    assert s(tx.strip, "　 a b \n") == "a b"
    assert one(spark, tx.wiki_links(F.col("c"), F.lit("me")), c="[[A|b]] ![[C#h|x]] [[ D ]] [[me]] [[A]] [[]]") == ["A", "C", "D"]
    assert s(tx.reply_links, "[[A#h|x]] [[B]] [[B]]") == ["A#h", "B"]
    assert s(tx.figure_ids, "Figure 32.4, fig 32-4 and 圖 3-1; <!-- REF: Fig. 1.2a -->") == ["Fig 1-2a", "Fig 32-4", "圖 3-1"]
    assert s(tx.chunk_kind, "| a |\n|--|\nx") == "table" and s(tx.chunk_kind, "# h\n\n| a |\n| b |") == "body" and s(tx.chunk_kind, "a\n<!-- REF: f -->") == "figure_caption"
    assert s(tx.token_estimate, "漢字漢 two words") == int(3 * 1.5 + 3 * 0.25)
    assert s(tx.strip_think, "<think>x\ny</think> ok") == "ok"
    assert s(tx.frontmatter_strip, "---\na: 1\n--- rest") == " rest" and s(tx.frontmatter_strip, "no") == "no"
    assert s(tx.drop_han_heavy_lines, "漢字\nab漢\n") == "ab漢\n"
    assert s(tx.note_names, "【A › b】 【C】") == ["A", "A › b", "C"]
    assert one(spark, tx.fuzzy_match("A.c", F.col("c")), c="xa..bc") and not one(spark, tx.fuzzy_match("cb", F.col("c")), c="abc")
    assert s(lambda c: tx.similarity_text(c.cast("double")), "0.456") == "0.46"
    assert s(tx.token_count, "fünf Wörter, 漢字!") == 6
    for v in ["a b c. d e f g", "x" * 50, "eins zwei. drei vier fünf sechs sieben acht neun zehn elf zwölf"]:
        for most in (3, 4, 6, 12):
            toks = [m.end() for m in re.finditer(r"[一-鿿]|[^\W一-鿿]+|[^\w\s]", v)]
            want = v
            if len(toks) > most:
                want = v[: toks[most - 1]]
                for sep in tx.SEPARATORS:
                    if (k := want.rfind(sep)) > 0.7 * len(want):
                        want = want[: k + len(sep)]
                        break
            assert s(lambda c, m=most: tx.truncate_tokens(c, m), v) == want
    for v in ("Ａ  ﬁ　x ", "a"):
        assert s(tx.section_path, v) == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v)).strip()


def test_frontmatter_and_chunks(spark):
    body = "---\ntitle: 'T x'\ntags: [a, \"b c\"]\naliases:\n  - one\n  - two\nempty:\n---\n\nIntro that is long enough to stay\n# Head one\ntext text text text\n## Sub\nshort\n#### Deep heading stays inside\nmore text of it here\n```\n# in a fence counts too, by the rule\n```"
    df = spark.createDataFrame([("f/n.md", "n", "f", 1.0, body), ("p.md", "p", "", 2.0, "# tiny\n# t2\n# t3 and more"), ("e.md", "e", "", 3.0, "x")], "file string, note string, folder string, mtime double, content string")
    rows = chunking.note_chunks(df).orderBy("id").collect()
    assert [(r.id, r.section) for r in rows] == [("f/n.md::0", "n"), ("f/n.md::1", "Head one"), ("f/n.md::2", "Sub"), ("f/n.md::3", "in a fence counts too, by the rule"), ("p.md::0", "p")]
    assert rows[0].tags == "a, b c" and rows[0].aliases == "one, two" and rows[4].text == "# tiny\n# t2\n# t3 and more"


def test_section_extract(spark):
    lines = ["# A", "x", "## B", "y", "### C", "z", "## D", "w"]
    get = lambda h: one(spark, tx.section_extract(F.col("c"), F.lit(h)), c=lines)
    assert get("b") == "## B\ny\n### C\nz" and get("D") == "## D\nw" and get("A").endswith("w") and get("none") is None


def test_entities(spark):
    for raw, want in {"The  Knees (left)": "knee", "OA": "osteoarthritis", "studies": "study", "series": "serie", "analyses": "analys", "biases": "biase", "the a gas": "gas", "NSAIDs": "nonsteroidal anti-inflammatory drug", "virus": "virus"}.items():
        assert one(spark, entities.normalise_entity(F.col("c")), c=raw) == want, raw
    assert one(spark, entities.normalise_relation(F.col("c")), c=" Used_In ") == "indicated_for" and one(spark, entities.normalise_relation(F.col("c")), c="?") == "associated_with"
    assert vocabulary.type_of_code("T047") == "condition" and vocabulary.type_of_code("X") is None
    found = spark.createDataFrame([("n", x, i) for i, x in enumerate(["#tag", "12.5 %", "ab", "Patients", "Knees", "knee", "Gait lab"])], "note string, name string, o int")
    assert {(r.name, r.canonical) for r in entities.filter_entities(found, order="o").collect()} == {("Knees", "knee"), ("Gait lab", "gait lab")}
    names = lambda s: s.map(lambda t: re.findall(r"[A-Z]\w+", t))

    notes = spark.createDataFrame([("n", "---\nx: y\n---\nKnees and Gait\n漢字漢字A\n")], "note string, content string")
    assert {r.canonical for r in entities.extract_entities(notes, names).collect()} == {"knee", "gait"}


# --- scores, windows, budgets


def test_scores(spark):
    now = 2_000_000_000.0
    for days, want in ((0, 1.0), (-5, 1.0), (365, 1 / (1 + 0.3 * math.log(2))), (5000, 0.7)):
        assert one(spark, scoring.recency_weight(F.col("m"), now), m=now - days * 86400) == pytest.approx(want)
    assert one(spark, scoring.recency_weight(F.lit(None), now), m=1) == 1.0 and one(spark, scoring.recency_weight(F.col("m"), now), m=float("nan")) == 1.0
    assert one(spark, scoring.path_weight(F.col("f"), {"a": 0.5}, archive="a", include_archived=True), f="a") == 1.0
    assert [one(spark, F.round(scoring.edition_boost(F.col("b")), 6), b=x) for x in ("x_1999", "x_2010", "x_2050", "x")] == [0.0, 0.01, 0.025, 0.0]
    assert scoring.intents("How to TREAT this?") == ["treats"] and scoring.intents("併發症") == ["complication_of"] and scoring.intents("x") == []
    assert [vector.over_fetch(p, 10) for p in ("api", "tool", "longform", "similar", "chat", "chat_longform")] == [30, 50, 100, 40, 30, 50]


def budgets(n):
    rem, out = 12000, []
    for k in range(n):
        want = 4000 if k == 0 else 2000 if k == 1 else max(400, rem // max(1, n - k))
        got = min(want, 4000, rem)
        out.append(got)
        rem -= got
    return out


def test_similarity_text_rounds_what_is_stored(spark):
    values = [i / 10_000 for i in range(-10_000, 10_001, 5)] + [0.125, 0.375, 1234.565]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "s double").select("s", tx.similarity_text(F.col("s")).alias("t"))
    assert all(r.t == ("?" if r.s is None else f"{r.s:.2f}") for r in df.collect())


def test_token_estimate_counts_words_once(spark):
    blanks = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    texts = ["", " ", "  ", "a", " a ", "a  b", " \n a\t\tb \u3000c\n", "漢字 é\x1fb", "\u200b", *[f"{b}a{b}{b}b {b}c{b} d{b}" for b in blanks]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", tx.word_count(F.col("t")).alias("n"), tx.token_estimate(F.col("t")).alias("e"))
    for r in df.collect():
        n = None if r.t is None else len([x for x in re.split(f"[{blanks}]+", r.t) if x])
        assert (r.n, r.e) == (n, None if n is None else int(1.5 * len(re.findall("[\u4e00-\u9fff]", r.t)) + n / 4))


def test_guard_scans_each_text_once(spark):
    p = spark.range(9).select(*[F.concat(F.lit(c), "id").alias(c) for c in ("history", "short_history", "context")])
    plan = context.guard_prompt(p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\x{4E00}-") == 3


def test_budgets(spark):
    got = {r.n: r.b for r in spark.range(0, 31).select(F.col("id").cast("int").alias("n"), dedup.budgets(F.col("id").cast("int")).alias("b")).collect()}
    assert got == {n: budgets(n) for n in range(31)} and all(sum(b) <= 12000 for b in got.values())


def test_embedding_failures(spark):
    import pandas as pd

    def brittle(s: pd.Series) -> pd.Series:
        if s.str.contains("bad").any():
            raise ValueError("no")
        return s.map(lambda t: [float("nan")] if t == "nan" else [float(len(t))])

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "ccc", "nan"])], "id int, text string")
    rows = {r.id: r for r in vector.embed_batches(df, brittle, with_error=True, tries=2).collect()}
    assert rows[0].vector == [1.0] and rows[2].vector == [3.0] and rows[1].vector is None and rows[1].error == "no" and rows[3].vector is None


# --- PageRank


def ppr(edges, seeds, d=0.85, n=30):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seeds = list(dict.fromkeys(seeds))
    restart = {s: 1 / len(seeds) for s in seeds}
    score = dict(restart)
    for _ in range(n):
        nxt = {}
        for x, s in score.items():
            for y in out.get(x, ()):
                nxt[y] = nxt.get(y, 0) + d * s / len(out[x])
        for s, r in restart.items():
            nxt[s] = nxt.get(s, 0) + (1 - d) * r
        score = nxt
    return score


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_pagerank(spark, kernel):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(25)} | {("x", "y")}
    edges = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    sets = {1: ["n1"], 2: ["n2", "n3", "n2"], 3: ["unknown", "n1"], 4: ["x"]}
    seeds = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "seed_set int, node string")
    got = {}
    for r in graph.personalized_pagerank(e, seeds, kernel_edges=kernel).collect():
        got.setdefault(r.seed_set, {})[r.note] = r.score
    for k, v in sets.items():
        want = {n: s for n, s in ppr(edges, v).items() if s > 0}
        assert set(got[k]) == set(want) and all(got[k][n] == pytest.approx(want[n], abs=1e-9) for n in want)
    assert sum(got[4].values()) == pytest.approx(1.0)


def test_large_graphs_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graph, "_kernel", lambda *a: pytest.fail("the edges were collected"))
    e = graph.symmetric(spark.range(110_000).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), "id").alias("dst")))
    seeds = spark.createDataFrame([(0, "a7")], "seed_set int, node string")
    got = {r.note: r.score for r in graph.personalized_pagerank(e, seeds, iterations=1).collect()}
    assert got == {"a7": pytest.approx(0.15), "b7": pytest.approx(0.85)}


def test_joined_pagerank_broadcasts_nothing(spark):
    e = graph.symmetric(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    df = graph.personalized_pagerank(e, spark.createDataFrame([(0, "a")], "seed_set int, node string"), kernel_edges=0, iterations=2)
    assert df.count() == 3 and df._jdf.queryExecution().executedPlan().toString().count("Broadcast") == 0


# --- long-form chunks


def test_slices():
    import pyarrow as pa

    texts = ["a" * 7, None, "é" * 2, "", "b" * 30, "c", None, "d" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(1).to_pylist() for p in batches.slices([batch.slice(0, 5), batch.slice(5)], "t", 11)]
    assert parts == [texts[:4], texts[4:5], texts[5:]]


def test_extractors_get_slices(spark):
    n = spark.range(3000).coalesce(1).select(F.concat(F.lit("B/f"), "id", F.lit(".md")).alias("note"), F.repeat(F.lit("ab "), 1400).alias("content"))

    def extractor(s):
        assert sum(map(len, s)) <= 1 << 20
        return s.map(lambda t: [t[:2] + "c"])

    assert entities.extract_entities(n, extractor).count() == 3000


def test_longform_rules():
    para = lambda n, w="w": " ".join([w] * n)
    build = lambda t: chunking.parents_of(t, file="B/c_1.md", book="B", chapter="c 1")
    assert [p["heading_origin"] for p in build("\n\n".join([para(600)] * 3))] == ["page_fallback"] * 3
    small = build(f"# Title\n{para(120)}\n## One\n{para(60)}\n## Two\n{para(500)}")
    assert [(p["heading_origin"], p["section_path"], p["chapter"]) for p in small] == [("H2", "", "Title"), ("H2", "One", "Title"), ("H2", "Two", "Title")]
    h3 = build(f"## A\n{para(150)}\n### x\n{para(900)}\n### y\n{para(1000)}\n\n{para(1000)}")
    assert [(p["heading_origin"], p["section_path"]) for p in h3] == [("H3", "A"), ("H3", "A > x"), ("paragraph_split", "A > y"), ("paragraph_split", "A > y")]
    table = "## T\n" + "\n".join("| a b c d e |" for _ in range(300))
    assert [p["heading_origin"] for p in build(table)] == ["H2"]
    merged = build(f"## A\n{para(2)}\n### x\n{para(30)}\n### y\n{para(40)}\n### z\n{para(1900)}")
    assert merged[0]["heading_origin"] == "merged_small_parent" and merged[0]["section_path"] == "A"
    paged = build(f"<!-- page 3 -->\n## A\n{para(50)}\n<!-- page 4 -->\n{para(50)}")
    assert (paged[0]["page_start"], paged[0]["page_end"]) == (3, 4) and "page 3" not in paged[0]["text"]
    assert build("") == [] and build("## A\nfew words") == []


def test_children_rules():
    parent = dict.fromkeys("file book chapter parent_id heading_origin section_path section_path_raw".split(), "p") | {"page_start": 1, "page_end": 2}
    kids = chunking.children_of(parent | {"text": "\n\n".join(" ".join([f"w{i}"] * 200) for i in range(8))})
    assert all(k["n_siblings"] == len(kids) and k["text"].startswith("[p — p > p]\n") for k in kids) and [k["chunk_idx"] for k in kids] == list(range(len(kids)))
    assert kids[1]["text"].split("\n", 1)[1].startswith(" ".join(["w1"] * 37))  # half the overlap, in words
    table = chunking.children_of(parent | {"text": "| h |\n|--|\n" + "\n".join("| a b c |" for _ in range(400))})
    assert {k["chunk_kind"] for k in table} == {"table_fragment"} and all("| h |\n|--|" in k["text"] for k in table)
    assert chunking.sentences("He met Dr. Smith. Then Fig. 2 came. 好。再来！") == ["He met Dr. Smith.", "Then Fig. 2 came.", "好。", "再来！"]
    assert [n for _, n in chunking.split_children("x" * 10, len, target=4, overlap=0)] == [4, 4, 2]
    assert chunking.children_of(parent | {"text": "too short"}) == []


def test_longform_frames(spark):
    text = "\n".join(f"## S{i}\n" + " ".join(f"w{j}" for j in range(700)) + f" Figure {i}.1" for i in range(3))
    files = spark.createDataFrame([("Book/ch_1.md", text, 1.0), ("loose.md", "", 2.0)], "file string, content string, mtime double")
    parents = chunking.longform_parents(files)
    kids = chunking.longform_children(parents)
    assert kids.join(parents.select("parent_id"), "parent_id", "left_anti").count() == 0
    assert {(r.book, tuple(r.figure_ids)) for r in parents.collect()} == {("Book", (f"Fig {i}-1",)) for i in range(3)}
    same = files.select(F.explode(F.split("content", " ")).alias("c")).select(tx.token_count(F.col("c")).alias("n")).agg(F.sum("n")).first()[0]
    assert same == chunking.count_tokens(text.replace(" ", " "))


# --- contexts


def test_context_policy_and_guard(spark):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([("hi", "rag"), ("a long question", "rag"), ("x", "free")], "message string, mode string").withColumn("selected", none).withColumn("mentioned", none).withColumn("active", F.lit("A" * 400))
    rows = {r.message: r for r in context.context_policy(df).collect()}
    assert rows["hi"].policy == "none" and rows["x"].policy == "none" and rows["a long question"].policy == "search" and len(rows["a long question"].query) == len("a long question") + 301
    assert one(spark, context.usage(F.col("c")), c='{"usage": {"input_tokens": 5}}').asDict() == {"input_tokens": 5, "output_tokens": 0, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    assert one(spark, context.usage(F.col("c")), c="not json").input_tokens == 0


def test_page_and_section_context(spark):
    text = "\n".join(f"<!-- page {i} -->\nline {i}" for i in range(1, 9))
    lines = chunking.page_lines(spark.createDataFrame([("f", text)], "file string, content string"))
    got = context.page_context(spark.createDataFrame([("f", 2), ("f", 7)], "file string, page int"), lines)
    assert {r.hit_page: r.context for r in got.collect()}[7] == "\n\n".join(f"[p.{i}] line {i}" for i in range(5, 9))
    sec = spark.createDataFrame([("f", i, f"s{i}") for i in range(4)], "file string, section_no int, text string")
    assert context.section_context(spark.createDataFrame([("f", 1)], "file string, section_no int"), sec).first().context == "s0\n\ns1\n\ns2"
    spans = spark.createDataFrame([("f", 0, 2, 5)], "file string, span int, first int, last int")
    r = chunking.span_text(lines, spans).first()
    assert (r.text, r.page_start, r.page_end) == ("line 2\n\nline 3", 2, 3)
