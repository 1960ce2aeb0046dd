"""A corpus from files to answers: index, change, search, the tool calls."""

from __future__ import annotations

import json

import pytest

from corvane.operators import vector
from corvane.plans import tools
from corvane.plans.index import Corpus
from corvane.settings import Settings


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for i in range(6):
        p = root / "notes" / f"f{i % 2}" / f"n{i}.md"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"---\ntags: [t{i}]\n---\n# About {['knee', 'gait', 'spine'][i % 3]}\n{['knee', 'gait', 'spine'][i % 3]} text that is long enough\n[[n{(i + 1) % 6}]]\n")
    book = root / "books" / "B_2010"
    book.mkdir(parents=True)
    for k in (1, 2):
        (book / f"ch0{k}_x.md").write_text(f"# Chapter {k}\n## Section\n" + " ".join(["gait"] * 40))
    (book / "full_text.md").write_text("whole")
    s = Settings.from_env({"CORVANE_NOTES_DIR": str(root / "notes"), "CORVANE_LONGFORM_DIR": str(root / "books"), "CORVANE_TABLES_DIR": str(root / "tables"), "CORVANE_EXCLUDE": "derived/, old/", "CORVANE_PATH_WEIGHTS": '{"_remark": 0, "f0": 1.1}'})
    assert s.exclude == ["derived/", "old/"] and s.path_weights == {"f0": 1.1} and s.embedding_dim == 64
    c = Corpus(spark, s)
    assert c.index_notes() == {"files": 6, "processed": 6, "errors": 0, "chunks": 6}
    assert c.index_longform() == {"parents": 2, "children": 2, "failed": 0}
    assert c.build_graph() == {"total_notes": 6, "notes_with_links": 6, "total_edges": 6}
    c.table("relations").overwrite(spark.createDataFrame([("Knees", "OA", "treats", "n1"), ("knee", "osteoarthritis", "causes", "n2"), ("gait", "spine", "part_of", "n2")], "`from` string, `to` string, type string, source_note string"))
    assert c.resolve() == 2
    return c, root


def test_incremental(corpus):
    c, root = corpus
    before = sorted(r.id for r in c.table("chunks").read().collect())
    assert c.index_notes(incremental=True)["processed"] == 0
    (root / "notes/f0/n0.md").write_text("# New head\nnew text that is long enough\n# Second\nmore new text of some length")
    (root / "notes/f1/n1.md").unlink()
    (root / "notes/f1/n3.md").write_bytes(b"\xff\xfe\xff")
    counts = c.index_notes(incremental=True)
    assert counts["processed"] == 1 and counts["errors"] == 1
    after = sorted(r.id for r in c.table("chunks").read().collect())
    assert after == sorted([x for x in before if "n1" not in x and "n3" not in x] + ["f0/n0.md::1"])
    full = Corpus(c.spark, Settings(**{**c.settings.__dict__, "tables_dir": str(root / "again")}))
    full.index_notes()
    assert sorted(r.id for r in full.table("chunks").read().collect()) == after


def test_single_note(corpus):
    c, root = corpus
    before = sorted((r.id, r.text) for r in c.table("chunks").read().where("file != 'f0/n2.md'").collect())
    (root / "notes/f0/n2.md").write_text("# Changed\nchanged text that is long enough")
    assert c.reindex_note("f0/n2.md") == {"chunks": 1, "errors": 0}
    assert [r.section for r in c.table("chunks").read().where("file = 'f0/n2.md'").collect()] == ["Changed"]
    (root / "notes/f0/n2.md").unlink()
    assert c.reindex_note("f0/n2.md") == {"chunks": 0, "errors": 0}
    assert sorted((r.id, r.text) for r in c.table("chunks").read().collect()) == before
    assert not {"f0/n2.md"} & {r.file for t in ("hashes", "notes") for r in c.table(t).read(["file"]).collect()}
    (root / "notes/f0/n2.md").write_text("---\ntags: [t2]\n---\n# About spine\nspine text that is long enough\n[[n3]]\n")
    assert c.reindex_note("f0/n2.md") == {"chunks": 1, "errors": 0}


def test_failed_children_wait_in_the_error_log(corpus, spark):
    import pandas as pd

    c, root = corpus
    good = vector.hashing_embedder(64)
    broken = Corpus(spark, Settings(**{**c.settings.__dict__, "tables_dir": str(root / "broken")}), lambda t: pd.Series([None if "gait" in (x or "") and "Chapter 2" in x else v for x, v in zip(t, good(t))]))
    p = root / "books" / "B_2010" / "ch02_x.md"
    p.write_text("# Chapter 2\n## Section\nChapter 2 " + " ".join(["gait"] * 40))
    state = lambda: {(r.file.split("/")[-1], r.status, r.retry_count) for r in broken.table("errors").read().collect()}
    assert broken.index_longform()["failed"] == 1 and state() == {("ch02_x.md", "pending", 1)}
    assert broken.index_longform(retry=True)["failed"] == 1 and state() == {("ch02_x.md", "pending", 2)}
    broken.embedder = good
    assert broken.index_longform(retry=True) == {"parents": 2, "children": 2, "failed": 0} and state() == {("ch02_x.md", "fixed", 2)}
    assert broken.index_longform(reset=True)["failed"] == 0 and state() == set()


def test_tools(corpus):
    c, _ = corpus
    rpc = lambda method, **params: json.loads(tools.answer(c, json.dumps(dict(id=1, method=method, params=params))))
    call = lambda name, **a: rpc("tools/call", name=name, arguments=a)["result"]["content"][0]["text"]
    assert {t["name"] for t in rpc("tools/list")["result"]["tools"]} == set(tools.TOOLS)
    assert rpc("initialize")["result"]["serverInfo"]["name"] == "corvane" and rpc("ping")["result"] == {}
    assert call("search", query="gait text", n_results=3).startswith("1. **n4**") and "tags: t4" in call("search", query="gait text", n_results=3)
    assert "**n" in call("related", note="n4") and "**n" in call("similar", note="n4")
    assert call("longform_search", query="gait", n_results=2).startswith("### 1. B_2010 › Section")
    assert json.loads(call("stats"))["children"]["total"] == 2
    assert "shared: knee, osteoarthritis" in call("bridges", note="N1")
    assert json.loads(call("reindex", file="f0/n4.md")) == {"chunks": 1, "errors": 0} and call("read", file="f0/n4").startswith("---\ntags: [t4]") and call("read", file="none") == ""
    assert "error" in rpc("tools/call", name="nothing") and "error" in rpc("tools/call", name="search", arguments={}) and rpc("other")["error"]["code"] == -32601
    assert tools.answer(c, '{"method": "notifications/x"}') is None and json.loads(tools.answer(c, "{"))["error"]["code"] == -32700
    assert len(list(tools.serve(c, ["", '{"id": 1, "method": "ping"}\n']))) == 1
