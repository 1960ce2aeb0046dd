"""The tool surface: named calls with JSON arguments, answered as Markdown; and the same over lines of JSON-RPC."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import functions as F

from corvane.operators import context, entities, stats
from corvane.plans import api
from corvane.plans.index import Corpus


def _search(c: Corpus, a: dict) -> str:
    s = c.settings
    profile = api.Profile(
        fetch="tool", path_weights=s.path_weights, archive=s.archive_folder or None, include_archived=bool(a.get("include_archived")), boost_recent=a.get("boost_recent", True),
        exclude=s.exclude if a.get("exclude_derived", True) else [],
    )
    rel = c.table("relations")
    hits = api.search(c.table("chunks").read(), c.embed(a["query"]), int(a.get("n_results", 10)), now=a.get("now", time.time()), query_text=a["query"], folder=a.get("folder"), relations=rel.read() if rel.exists() else None, profile=profile)
    if not a.get("include_excerpt", True):
        hits = hits.withColumn("text", F.lit(""))
    out = context.render_results(hits).first().markdown or ""
    edges = c.table("edges")
    if edges.exists():
        linked = [r.note for r in api.search_expanded(hits, edges.read()).orderBy("rank").collect()]
        out += "\n\nLinked: " + ", ".join(linked) if linked else ""
    return out


def _related(c: Corpus, a: dict) -> str:
    got = api.related(c.table("edges").read(), c.table("notes").read(), a["note"], int(a.get("n_results", 12)), existing_only=bool(a.get("existing_only")))
    rows = got.select((F.col("rank") - 1).alias("rank"), "note", F.lit("").alias("section"), "folder", F.round("score", 4).alias("similarity"), F.lit("").alias("tags"), F.lit("").alias("text"))
    return context.render_results(rows).first().markdown or ""


def _similar(c: Corpus, a: dict) -> str:
    got = api.similar(c.table("chunks").read(), c.table("edges").read(), a["note"], int(a.get("n_results", 10)), now=a.get("now", time.time()))
    return context.render_results(got.select("rank", "note", F.lit("").alias("section"), "folder", "similarity", F.lit("").alias("tags"), F.lit("").alias("text"))).first().markdown or ""


def _longform(c: Corpus, a: dict) -> str:
    profile = api.Profile(fetch="tool", exclude=c.settings.exclude if a.get("exclude_derived", True) else [], source_boost=a.get("source_boost"))
    got = api.longform_search(c.table("children").read(), c.table("parents").read(), c.embed(a["query"]), int(a.get("n_results", 10)), book=a.get("book"), full_parent=a.get("full_parent", True), profile=profile)
    return context.render_longform(got).first().markdown or ""


def _stats(c: Corpus, _: dict) -> str:
    out = {}
    for name, group in (("chunks", "folder"), ("children", "book")):
        t = c.table(name)
        if t.exists():
            rows = stats.by_group(t.read(["file", group]), group).limit(50).collect()  # the largest groups; the totals are of all
            out[name] = {"total": t.count(), group: {r[group]: {"chunks": r.chunks, "files": r.files} for r in rows}}
    return json.dumps(out, ensure_ascii=False, indent=1)


def _bridges(c: Corpus, a: dict) -> str:
    rows = entities.bridges_for(c.table("entities").read(), a["note"]).collect()
    return "\n".join(f"{i}. **{r.note}** — {r['count']} shared: {', '.join(r.shared_entities)}" for i, r in enumerate(rows, 1))


def _reindex(c: Corpus, a: dict) -> str:
    return json.dumps(c.reindex_note(a["file"]))


def _read(c: Corpus, a: dict) -> str:
    wanted = c.spark.createDataFrame([(a["file"],)], "path string")
    return context.full_notes(wanted, c.table("notes").read()).first().content


#: Name: (function, required arguments, optional ones).
TOOLS: dict[str, tuple[Callable[[Corpus, dict], str], list[str], list[str]]] = {
    "search": (_search, ["query"], ["n_results", "folder", "include_excerpt", "boost_recent", "include_archived", "exclude_derived"]),
    "related": (_related, ["note"], ["n_results", "existing_only"]),
    "similar": (_similar, ["note"], ["n_results"]),
    "longform_search": (_longform, ["query"], ["n_results", "book", "full_parent", "exclude_derived", "source_boost"]),
    "stats": (_stats, [], []),
    "bridges": (_bridges, ["note"], []),
    "reindex": (_reindex, ["file"], []),
    "read": (_read, ["file"], []),
}


def call(corpus: Corpus, name: str, arguments: dict) -> str:
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    run, required, _ = TOOLS[name]
    if missing := [k for k in required if not arguments.get(k)]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return run(corpus, arguments)


def _reply(number, **outcome) -> str:
    return json.dumps(dict(jsonrpc="2.0", id=number) | outcome, ensure_ascii=False)


def answer(corpus: Corpus, line: str) -> str | None:
    """One JSON-RPC request (initialize, tools/list, tools/call, ping); notifications have no answer."""
    try:
        r = json.loads(line)
    except ValueError:
        return _reply(None, error=dict(code=-32700, message="not JSON"))
    method, params = r.get("method"), r.get("params") or {}
    if "id" not in r:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "corvane", "version": "1"}, "capabilities": {"tools": {}}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": k, "inputSchema": dict(required=need, properties={x: {} for x in [*need, *may]}, type="object")} for k, (_, need, may) in TOOLS.items()]}
        elif method == "tools/call":
            said = call(corpus, params.get("name", ""), params.get("arguments") or {})
            result = dict(content=[dict(text=said, type="text")])
        else:
            return _reply(r["id"], error=dict(code=-32601, message=f"no method {method}"))
    except (KeyError, ValueError, FileNotFoundError) as e:
        return _reply(r["id"], error=dict(code=-32602, message=str(e)))
    return _reply(r["id"], result=result)


def serve(corpus: Corpus, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip() and (out := answer(corpus, line)) is not None:
            yield out


def main(argv: list[str] | None = None) -> None:
    """python -m corvane.plans.tools index [--incremental] | longform [--book B] [--retry] [--reset] | graph | resolve | stats | bridges NOTE | serve"""
    import argparse

    from corvane.session import session
    from corvane.settings import Settings

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("what", choices=["index", "longform", "graph", "resolve", "stats", "bridges", "serve"])
    p.add_argument("note", nargs="?")
    p.add_argument("--book")
    p.add_argument("--incremental", default=False, action="store_true")
    p.add_argument("--retry", default=False, action="store_true")
    p.add_argument("--reset", default=False, action="store_true")
    a = p.parse_args(argv)
    corpus = Corpus(session(), Settings.from_env())
    if a.what == "serve":
        for out in serve(corpus, sys.stdin):
            print(out, flush=True)
        return
    print({
        "index": lambda: corpus.index_notes(incremental=a.incremental), "longform": lambda: corpus.index_longform(book=a.book, retry=a.retry, reset=a.reset), "graph": corpus.build_graph,
        "resolve": corpus.resolve, "stats": lambda: call(corpus, "stats", {}), "bridges": lambda: call(corpus, "bridges", {"note": a.note}),
    }[a.what]())


if __name__ == "__main__":
    main()
