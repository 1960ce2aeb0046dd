"""Contexts, histories, transcripts and rendered results (CTX-*, REN-*, SNK-10, TXT-24..26, FLT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import dedup


def exclude(df: DataFrame, words: list[str], *columns: str) -> DataFrame:
    """FLT-3: rows of whose columns none contains one of the words, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        for w in words:
            hit = hit | F.coalesce(F.lower(c).contains(w.lower()), F.lit(False))
    return df.where(~hit)


def exclude_folders(df: DataFrame, folders: list[str], path: str = "file") -> DataFrame:
    """FLT-4: rows outside the folders, by prefix of the path."""
    hit = F.lit(False)
    for f in folders:
        hit = hit | F.lower(path).startswith(f.lower() + "/") | F.lower(path).startswith(f.lower() + "\\")
    return df.where(~hit)


def floor(df: DataFrame, least: float = 0.5, score: str = "similarity") -> DataFrame:
    """FLT-5."""
    return df.where(F.col(score) >= least)


def tier(score: Column, *, first: float = 0.7, second: float = 0.5) -> Column:
    """FLT-6."""
    return F.when(score >= first, "primary").when(score >= second, "secondary").otherwise("hidden")


def by_keys(rows: DataFrame, keys: DataFrame, key: str = "parent_id") -> DataFrame:
    """FLT-2: the rows of the keys listed; a short list is broadcast by the planner, a long one is not."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def autocomplete(names: DataFrame, typed: str, k: int = 10) -> DataFrame:
    """TOP-5: names by kind of match (0 equal, 1 beginning, 2 within, 3 letters in order), then by length."""
    q, low = typed.lower(), F.lower("name")
    kind = F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2).when(tx.fuzzy_match(typed, F.col("name")), 3)
    return names.select("name").distinct().withColumn("kind", kind).where(F.col("kind").isNotNull()).orderBy("kind", F.length("name"), "name").limit(k)


def notes_context(chunks: DataFrame, names: DataFrame, *, most: int = 100, cut: int = 3000) -> DataFrame:
    """CTX-2: for each named note (note, place) its chunks in order under their sections, cut, with a header line."""
    mine = dedup.keep_n(chunks.join(names.select("note", "place"), "note"), "note", most, "chunk_idx")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n")
    whole = mine.groupBy("note", "place").agg(body.alias("b"))
    return whole.select("note", "place", F.concat(F.lit("【"), F.col("note"), F.lit("】\n"), F.when(F.length("b") > cut, F.concat(F.substring("b", 1, cut), F.lit("..."))).otherwise(F.col("b"))).alias("block"))


def join_blocks(blocks: DataFrame, *, order: str = "place") -> DataFrame:
    """The blocks of a context in one text, a row of its own."""
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def rag_blocks(results: DataFrame, *, cut: int, longform: bool = False) -> DataFrame:
    """CTX-3, CTX-4: (rank, note, section, similarity, text) results, or (rank, book, file, section, similarity, text) long-form ones, as blocks."""
    parts = ["book", "file", "section"] if longform else ["note", "section"]
    name = F.concat_ws(" › ", *[F.coalesce(p, F.lit("")) for p in parts])
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)
    head = F.concat(F.lit("【📖 " if longform else "【"), name, F.lit("】(sim="), tx.similarity_text(F.col("similarity")), F.lit(")\n"))
    return results.select(F.col("rank").alias("place"), F.concat(head, body).alias("block"))


def full_notes(wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """CTX-1: (path, content) of the paths wanted: the note of that file, else of the path with ".md", else an empty text."""
    exact = notes.select(F.col("file").alias("path"), F.col("content").alias("exact__"))
    short = notes.where(F.col("file").endswith(".md")).select(F.regexp_replace("file", r"\.md$", "").alias("path"), F.col("content").alias("short__"))
    short = short.where(~F.col("path").endswith(".md"))
    return wanted.select("path").join(exact, "path", "left").join(short, "path", "left").select("path", F.coalesce("exact__", "short__", F.lit("")).alias("content"))


def with_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """JOIN-1: children with their parent's text and token count; empty and 0 where there is no such parent."""
    theirs = parents.select("parent_id", F.col("text").alias("parent_full"), F.col("token_count").alias("parent_tokens"))
    return children.join(theirs, "parent_id", "left").withColumn("parent_full", F.coalesce("parent_full", F.lit(""))).withColumn("parent_tokens", F.coalesce(F.col("parent_tokens").cast("long"), F.lit(0)))


def page_context(hits: DataFrame, lines: DataFrame, *, reach: int = 2, cut: int = 6000) -> DataFrame:
    """TXT-26, JOIN-11: the pages around each hit (file, page), as "[p.N] text".

    The range join is an equi-join on (file, page): each hit is exploded to its 2 * reach + 1 pages first.
    """
    around = hits.select("file", F.col("page").alias("hit_page")).distinct().withColumn("page", F.explode(F.sequence(F.col("hit_page") - reach, F.col("hit_page") + reach)))
    pages = lines.where("page > 0").join(around.select("file", "page").distinct(), ["file", "page"], "left_semi").groupBy("file", "page").agg(
        tx.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("t")
    )
    got = around.join(pages, ["file", "page"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(F.lit("[p."), x["page"].cast("string"), F.lit("] "), x["t"])), "\n\n")
    return got.groupBy("file", "hit_page").agg(F.substring(joined, 1, cut).alias("context"))


def section_context(hits: DataFrame, sections: DataFrame, *, cut: int = 6000) -> DataFrame:
    """TXT-26 without page marks: the sections before, at and behind the hit's (file, section_no)."""
    around = hits.select("file", F.col("section_no").alias("hit_no")).distinct().withColumn("section_no", F.explode(F.sequence(F.col("hit_no") - 1, F.col("hit_no") + 1)))
    got = around.join(sections, ["file", "section_no"])
    return got.groupBy("file", "hit_no").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "text"))), lambda x: x["text"]), "\n\n"), 1, cut).alias("context"))


def excerpt(content: Column, section: Column | None = None, *, cut: int = 800) -> Column:
    """TXT-25: the section, else 800 characters (`cut`) of the body behind the frontmatter; 1000 at most, then an ellipsis."""
    body = F.substring(tx.strip(tx.frontmatter_strip(content)), 1, cut)
    t = F.coalesce(section, body) if section is not None else body
    return F.when(F.length(t) > 1000, F.concat(F.substring(t, 1, 1000), F.lit("…"))).otherwise(t)


def context_policy(requests: DataFrame) -> DataFrame:
    """CTX-5: what each request (message, mode, selected, mentioned, active) is answered from, and the query it asks with."""
    picked, named = F.size("selected") > 0, F.size("mentioned") > 0
    short = (F.length(tx.strip(F.col("message"))) <= 5) & ~picked
    policy = F.when((F.col("mode") == "free") | short, "none").when(picked, "selected").when(named, "mentioned+search").otherwise("search")
    active = F.coalesce("active", F.lit(""))
    query = F.when(active != "", F.concat(F.col("message"), F.lit("\n"), F.substring(active, 1, 300))).otherwise(F.col("message"))
    return requests.withColumn("policy", policy).withColumn("query", query).withColumn("notes", F.array_union("selected", "mentioned"))


def guard_prompt(prompt: DataFrame, *, most: int = 80_000, most_context: int | None = None, sep: str = "\n\n---\n\n", keep: int = 3) -> DataFrame:
    """CTX-7: (history, short_history, context): above `most` estimated tokens the short history is used, and if still above only the first notes.

    most_context, if given, is the second limit.
    """
    first = F.array_join(F.slice(F.split("context", "\\Q" + sep + "\\E"), 1, keep), sep)
    parts = [f"{p}__" for p in ("history", "short_history", "context")]
    sized = prompt.select("*", *[tx.token_estimate(F.col(p.removesuffix("__"))).alias(p) for p in parts])  # each text is scanned once
    history, short, context = map(F.col, parts)
    long, still = history + context > most, short + context > (most if most_context is None else most_context)
    used = sized.withColumns({"used_history": F.when(long, F.col("short_history")).otherwise(F.col("history")), "used_context": F.when(long & still, first).otherwise(F.col("context"))})
    return used.drop(*parts)


def usage(reply: Column) -> Column:
    """CTX-8: token counts of a reply's JSON, 0 where missing."""
    got = F.from_json(reply, "usage struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>")["usage"]
    zero = lambda name: F.coalesce(got[name], F.lit(0).cast("long")).alias(name)
    return F.struct(*[zero(n) for n in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")])


def transcript(turns: DataFrame, *, date: str) -> DataFrame:
    """SNK-10: each conversation as Markdown, and the file name it goes by."""
    title = lambda role: F.when(role == "user", "## User").when(role == "assistant", "## Assistant").otherwise(F.concat(F.lit("## "), F.initcap(role)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    opening = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    got = turns.groupBy("conv_id").agg(parts.alias("parts"), opening.alias("first"), F.count(F.lit(1)).alias("messages"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(title(p["role"]), F.lit("\n\n"), p["text"])), "\n\n")
    head = F.concat(F.lit(f"---\ndate: {date}\nmessages: "), F.col("messages").cast("string"), F.lit("\n---\n\n"))
    name = F.concat(F.lit(date + "_"), F.regexp_replace(F.substring(F.coalesce("first", F.lit("chat")), 1, 30), r'[\\/:*?"<>|#^\[\]\n\r]', "_"), F.lit(".md"))
    return got.select("conv_id", name.alias("file"), F.concat(head, body).alias("content"))


def reply_suggestions(replies: DataFrame, notes: DataFrame, context: DataFrame) -> DataFrame:
    """TXT-23: linked notes of each reply (reply_id, text) that exist and are not in its context (reply_id, note) yet."""
    links = replies.select("reply_id", F.explode(tx.reply_links(F.col("text"))).alias("note"))
    return links.join(notes.select("note").distinct(), "note", "left_semi").join(context.select("reply_id", "note"), ["reply_id", "note"], "left_anti")


def render_results(results: DataFrame, *, excerpt_chars: int = 500) -> DataFrame:
    """REN-1, REN-2: result rows (rank, note, section, folder, similarity, tags, text) as one Markdown text."""
    line = F.concat(
        (F.col("rank") + 1).cast("string"), F.lit(". **"), F.col("note"), F.lit("**"),
        F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" — "), F.col("section"))).otherwise(""),
        F.when(F.coalesce("folder", F.lit("")) != "", F.concat(F.lit(" · "), F.col("folder"))).otherwise(""),
        F.lit(" · sim "), tx.similarity_text(F.col("similarity")),
        F.when(F.coalesce("tags", F.lit("")) != "", F.concat(F.lit("\n   tags: "), F.col("tags"))).otherwise(""),
        F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("\n   > "), F.regexp_replace(F.substring("text", 1, excerpt_chars), r"\n", " "))).otherwise(""),
    )
    return results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("markdown"))


def render_longform(results: DataFrame) -> DataFrame:
    """REN-3: long-form rows (rank, book, section_path, page_start, page_end, file, similarity, parent_text, figure_ids)."""
    pages = F.when(F.col("page_start") > 0, F.concat(F.lit(" · p."), F.col("page_start").cast("string"), F.when(F.col("page_end") != F.col("page_start"), F.concat(F.lit("-"), F.col("page_end").cast("string"))).otherwise(""))).otherwise("")
    line = F.concat(
        F.lit("### "), (F.col("rank") + 1).cast("string"), F.lit(". "), F.col("book"), F.when(F.col("section_path") != "", F.concat(F.lit(" › "), F.col("section_path"))).otherwise(""), pages,
        F.lit(" · sim "), tx.similarity_text(F.col("similarity")), F.lit("\n"), F.col("file"), F.lit("\n\n"), F.coalesce("parent_text", F.lit("")),
        F.when(F.size("figure_ids") > 0, F.concat(F.lit("\n\nFigures: "), F.array_join("figure_ids", ", "))).otherwise(""),
    )
    return results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("markdown"))
