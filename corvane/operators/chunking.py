"""Notes and long-form texts as chunk tables (TXT-3, TXT-6..20)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.batches import slices

PARENT_MAX, PARENT_MIN, PACK, CHILD, OVERLAP, CHILD_MIN_CHARS, TABLE_MAX, LEAST = 1800, 100, 1024, 512, 75, 200, 3000, 20
Counter = Callable[[str], int]
_TOKEN = re.compile(r"[一-鿿]|[^\W一-鿿]+|[^\w\s]")


def count_tokens(s: str) -> int:
    """The counter used where no tokenizer is given; functions.text.token_count counts alike."""
    return len(_TOKEN.findall(s))


def note_chunks(notes: DataFrame, *, cut: int = 4000) -> DataFrame:
    """TXT-1, TXT-3, TXT-4: notes (file, note, folder, mtime, content) to chunks, one per heading of level 1 to 3.

    Pieces of 20 characters or fewer go; if all go, the whole body is one chunk if it is longer than that.
    """
    block, body = tx.frontmatter_split(F.col("content"))
    listed = lambda key: F.array_join(tx.frontmatter_value(F.coalesce(F.col("block"), F.lit("")), key), ", ")
    base = notes.select("file", "note", "folder", "mtime", block.alias("block"), body.alias("body")).where(F.length("body") > 0)
    pieces = base.withColumn("pieces", F.filter(F.transform(tx.heading_pieces(F.col("body")), tx.strip), lambda p: F.length(p) > 20))
    whole = F.when((F.size("pieces") == 0) & (F.length("body") > 20), F.array("body")).otherwise(F.col("pieces"))
    return pieces.select("file", "note", "folder", listed("tags").alias("tags"), listed("aliases").alias("aliases"), "mtime", F.size("pieces").alias("n"), F.posexplode(whole).alias("idx", "text")).select(
        F.concat("file", F.lit("::"), F.col("idx").cast("string")).alias("id"), F.substring("text", 1, cut).alias("text"), "file", "note",
        F.when(F.col("n") == 0, F.col("note")).otherwise(tx.piece_section(F.col("text"), F.col("note"))).alias("section"), "folder", "tags", "aliases", "mtime",
    )


def page_lines(files: DataFrame, *, content: str = "content") -> DataFrame:
    """TXT-6, WIN-7: (file, line_no, line, page, level, heading); a page mark sets the page from its line on and is blanked."""
    lines = files.select("file", F.posexplode(F.split(content, "\n")).alias("line_no", "raw"))
    mark = F.regexp_extract("raw", r"<!--\s*page\s+([0-9]+)\s*-->", 1)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    page = F.coalesce(F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(w), F.lit(0))
    head = r"^(?:(#{1,6}))\s+(.+)$"
    level = F.length(F.regexp_extract("raw", head, 1))
    return lines.select(
        "file", "line_no", F.when(mark != "", F.lit("")).otherwise(F.col("raw")).alias("line"), page.alias("page"),
        F.when((mark == "") & level.between(1, 3), level).alias("level"), F.when((mark == "") & level.between(1, 3), tx.strip(F.regexp_extract("raw", head, 2))).alias("heading"),
    )


def table_blocks(lines: DataFrame) -> DataFrame:
    """TXT-7: (file, first, last) of every run of two or more table lines, by gaps and islands."""
    flagged = lines.where(F.col("line").rlike(r"^\s*\|"))
    w = Window.partitionBy("file").orderBy("line_no")
    isl = flagged.withColumn("island", F.col("line_no") - F.row_number().over(w))
    return isl.groupBy("file", "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).where(F.col("last") > F.col("first")).drop("island")


def span_text(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """TXT-8: the text and page span of line ranges (file, span, first, last)."""
    inside = lines.join(spans, "file").where(F.col("line_no").between(F.col("first"), F.col("last")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    paged = F.when(F.col("page") > 0, F.struct("line_no", "page"))
    return inside.groupBy("file", "span").agg(
        F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), r"^\n+|\n+$", "").alias("text"),
        F.coalesce(F.min(paged)["page"], F.lit(0)).alias("page_start"), F.coalesce(F.max(paged)["page"], F.lit(0)).alias("page_end"),
    )


# Long-form chunking depends on order and on running token sums: one file is one unit of work, in an Arrow batch.


def pack_paragraphs(text: str, target: int, count: Counter) -> list[str]:
    """TXT-9: paragraphs filled up to the target."""
    packed: list[str] = []
    size = 0
    for p in map(str.strip, re.split(r"\n{2,}", text)):
        if not p:
            continue
        n = count(p)
        if packed and size + n <= target:
            packed[-1] += "\n\n" + p
            size += n
        else:
            packed.append(p)
            size = n
    return packed


class _File:
    """A long-form file by lines, with the page of each line and the headings of levels 1 to 3."""

    def __init__(self, content: str) -> None:
        self.lines: list[str] = []
        self.pages: list[int] = []
        self.heads: list[tuple[int, int, str]] = []  # (line, level, text)
        page = 0
        for i, raw in enumerate(content.split("\n")):
            m = re.search(r"<!--\s*page\s+([0-9]+)\s*-->", raw)
            if m:
                page = int(m[1])
            elif (h := re.match(r"(?:(#{1,6}))\s+(.+)$", raw)) and len(h[1]) <= 3:
                self.heads.append((i, len(h[1]), h[2].strip()))
            self.lines.append("" if m else raw)
            self.pages.append(page)

    def span(self, a: int, b: int) -> tuple[str, int, int]:
        known = [p for p in self.pages[a:b] if p > 0]
        return "\n".join(self.lines[a:b]).strip("\n"), known[0] if known else 0, known[-1] if known else 0

    def big_table(self, a: int, b: int, count: Counter) -> str | None:
        """TXT-11: the first table block of more than PARENT_MAX tokens."""
        i = a
        while i < b:
            j = i
            while j < len(self.lines) and self.lines[j].lstrip().startswith("|"):
                j += 1
            if j - i >= 2:
                t = self.span(i, min(j, b))[0]
                if count(t) > PARENT_MAX:
                    return t
            i = max(j, i + 1)
        return None


def parents_of(content: str, *, file: str, book: str, chapter: str, count: Counter = count_tokens) -> list[dict]:
    """TXT-10..13: the parent sections of one file."""
    doc = _File(content)
    chapter = next((t for _, lv, t in doc.heads if lv == 1), chapter)
    end = len(doc.lines)
    h2 = [(i, t) for i, lv, t in doc.heads if lv == 2]
    h3 = [(i, t) for i, lv, t in doc.heads if lv == 3]
    sections: list[dict] = []

    def add(text: str, pages: tuple[int, int], a: str, b: str, origin: str) -> None:
        sections.append({"text": text, "p0": pages[0], "p1": pages[1], "h2": a, "h3": b, "path": [x for x in (a, b) if x], "origin": origin})

    def packed(text: str, pages: tuple[int, int], a: str, b: str, origin: str) -> None:
        for t in pack_paragraphs(text, PACK, count):
            add(t, pages, a, b, origin)

    if not h2:
        text, *pages = doc.span(0, end)
        if text.strip():
            packed(text, tuple(pages), "", "", "page_fallback")
    else:
        text, *pages = doc.span(0, h2[0][0])
        if h2[0][0] > 0 and count(text) >= PARENT_MIN:
            add(text, tuple(pages), "", "", "H2")
        for (a, title), b in zip(h2, [*[i for i, _ in h2[1:]], end], strict=True):
            text, *pages = doc.span(a, b)
            if not text.strip():
                continue
            inner = [(i, t) for i, t in h3 if a <= i < b]
            table = doc.big_table(a, b, count) if count(text) > PARENT_MAX else None
            if count(text) <= PARENT_MAX or (table is not None and count(table) <= TABLE_MAX):
                add(text, tuple(pages), title, "", "H2")
            elif not inner:
                packed(text, tuple(pages), title, "", "paragraph_split")
            else:
                before, *bp = doc.span(a + 1, inner[0][0])
                if inner[0][0] > a + 1 and count(before) >= PARENT_MIN:
                    add(before, tuple(bp), title, "", "H3")
                for (i, sub), j in zip(inner, [*[k for k, _ in inner[1:]], b], strict=True):
                    part, *pp = doc.span(i, j)
                    if count(part) <= PARENT_MAX:
                        add(part, tuple(pp), title, sub, "H3")
                    else:
                        packed(part, tuple(pp), title, sub, "paragraph_split")
        sections = _merge_small(sections, count)
    return _finish(sections, file=file, book=book, chapter=chapter, count=count)


def _merge_small(sections: list[dict], count: Counter) -> list[dict]:
    """TXT-12: neighbours of one H2 that are both small, two at a time."""
    out: list[dict] = []
    rest = list(reversed(sections))
    while rest:
        a = rest.pop()
        if rest and a["h2"] == rest[-1]["h2"] and max(count(a["text"]), count(rest[-1]["text"])) < PARENT_MIN:
            b = rest.pop()
            same = a["h3"] == b["h3"]
            a = {
                "text": f"{a['text']}\n\n{b['text']}", "p0": a["p0"] or b["p0"], "p1": b["p1"] or a["p1"], "h2": a["h2"],
                "h3": a["h3"] if same else "", "path": a["path"] if same else a["path"][:1], "origin": "merged_small_parent",
            }
        out.append(a)
    return out


def _finish(sections: list[dict], *, file: str, book: str, chapter: str, count: Counter) -> list[dict]:
    """TXT-13, SCL-7: ids count all sections; those below LEAST tokens are dropped."""
    rows = []
    for k, s in enumerate(sections):
        text = s["text"].strip()
        n = count(text)
        if not text or n < LEAST:
            continue
        raw = " > ".join(s["path"])
        key = "|".join((book, file, chapter or "", s["h2"], s["h3"], str(s["p0"]), str(k), s["origin"]))
        rows.append(dict(
            parent_id=hashlib.md5(key.encode("utf-8", "replace")).hexdigest(), heading_origin=s["origin"], token_count=n, page_end=s["p1"], page_start=s["p0"],
            section_path_raw=raw, section_path=re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw)).strip(), chapter=chapter, book=book, file=file, text=text,
        ))
    return rows


_SHORT_FORMS = frozenset(
    "4e. 5e. 6e. 7e. Ch. Dr. Eq. Fig. Jr. Mr. Mrs. Ms. No. Prof. Sr. St. Vol. approx. cm. e.g. etc. i.e. kg. mL. mg. mm. mmHg. p. pp. vs.".split()
) | {"et al."}


def sentences(text: str) -> list[str]:
    """TXT-14: sentence ends of Han and Latin script; a piece that ends in a short form takes the next one to it, once."""
    cut = [s.strip() for z in re.split(r"(?<=[。！？；])", text) if z for s in re.split(r"(?<=[?.!])\s+(?=[一-鿿A-Z])", z) if s.strip()]
    out, joined = [], False
    for s in cut:
        if out and not joined and out[-1].split()[-1] in _SHORT_FORMS:
            out[-1], joined = f"{out[-1]} {s}", True
        else:
            out.append(s)
            joined = False
    return out


def split_children(text: str, count: Counter, *, target: int = CHILD, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """TXT-15: (text, tokens) pieces of the coarsest units that divide the text, each begun with the end of the one before."""
    if (whole := count(text)) <= target:
        return [(text, whole)] if text.strip() else []
    lines, paragraphs = text.split("\n"), re.split(r"\n{2,}", text)
    units = next((u for u in (paragraphs, lines, sentences(text), text.split()) if len(u) > 1), list(text))
    in_paragraphs, in_lines = set(paragraphs), set(lines)
    out: list[tuple[str, int]] = []
    held, size = "", 0
    for u in units:
        n = count(u)
        if held and size + n > target:
            out.append((held, size))
            if overlap > 0:
                tail = " ".join(held.split()[-max(1, overlap // 2) :])
                between = " " if u.find("\n") < 0 else "\n"
                held = f"{tail}{between}{u}"
                size = count(held)
            else:
                held, size = u, n
        else:
            glue = "\n\n" if u in in_paragraphs else "\n" if u in in_lines else " "
            held = held + glue + u if held else u
            size += n
    if held.strip():
        out.append((held, size))
    return out


def classify(text: str) -> str:
    """TXT-16, as functions.text.chunk_kind."""
    top = text.split("\n")[:3]
    if sum(x.lstrip().startswith("|") for x in top) >= 2:
        return "table"
    return "figure_caption" if any("<!-- REF:" in x for x in top) else "body"


def table_fragments(text: str, count: Counter) -> list[tuple[str, bool]]:
    """TXT-17: (text, fragment) pieces of a table, each below its two header lines."""
    head, rows = text.split("\n")[:2], text.split("\n")[2:]
    if not rows:
        return [(text, False)]
    top = "\n".join(head)
    groups: list[list[str]] = [[]]
    size, own = 0, count(top)
    for r in rows:
        n = count(r)
        if groups[-1] and size + n + own > CHILD:
            groups.append([])
            size = 0
        groups[-1].append(r)
        size += n
    return [("\n".join([top, *g]), len(groups) > 1) for g in groups]


def children_of(parent: dict, count: Counter = count_tokens) -> list[dict]:
    """TXT-18..20: the children of one parent, those of fewer than LEAST tokens left out."""
    text = parent["text"]
    pieces: list[tuple[str, str, int | None]]
    if count(text) <= CHILD:
        pieces = [(text, classify(text), None)]
    elif classify(text) == "table":
        # a lone last fragment of several counts as one, the first of a single table does not
        pieces = [(t, "table_fragment" if f else "table", None) for t, f in table_fragments(text, count)]
    else:
        glued: list[list] = []
        for t, n in split_children(text, count):
            if glued and len(t) < CHILD_MIN_CHARS:
                glued[-1][0] += "\n\n" + t
                glued[-1][1] = count(glued[-1][0])
            else:
                glued.append([t, n])
        pieces = [(t, classify(t), n) for t, n in glued]
    place = " — ".join((parent["book"], parent["chapter"]))
    lead = "[" + " > ".join(x for x in (place, parent["section_path"]) if x) + "]\n"
    rows = []
    for k, (t, kind, n) in enumerate(pieces):
        tokens = n or count(lead + t)
        if tokens < LEAST:
            continue
        same = {c: parent[c] for c in "file book chapter page_start page_end parent_id heading_origin section_path section_path_raw".split()}
        rows.append({"id": hashlib.md5(f"{parent['file']}|{parent['parent_id']}|{k}".encode()).hexdigest(), "text": lead + t, "body": t, "chunk_kind": kind, "chunk_idx": k, "n_siblings": len(pieces), "token_count": tokens} | same)
    return rows


_PARENT = "parent_id string, text string, file string, book string, chapter string, section_path string, section_path_raw string, page_start int, page_end int, token_count int, heading_origin string, mtime double"
_CHILDREN = "id string, text string, body string, parent_id string, file string, book string, chapter string, section_path string, section_path_raw string, page_start int, page_end int, chunk_kind string, chunk_idx int, n_siblings int, token_count int, heading_origin string, mtime double"


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _by_rows(df: DataFrame, column: str, rows_of: Callable[[dict, Counter], list[dict]], schema: str, count: Counter) -> DataFrame:
    """rows_of(row, counter) of every row; a worker holds a slice of a batch (bounded by the bytes of `column`) and its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = lru_cache(maxsize=256)(count)  # a section is weighed several times by the rules, then not again
        for part in slices(batches, column):
            yield pa.RecordBatch.from_pylist([r for row in part.to_pylist() for r in rows_of(row, counted)], schema=_arrow(schema))

    return df.mapInArrow(run, schema)


def longform_parents(files: DataFrame, count: Counter = count_tokens) -> DataFrame:
    """TXT-6..13 over files (file, content, mtime): a map, as every file is a row; no shuffle."""

    def rows_of(row: dict, counted: Counter) -> list[dict]:
        parts = row["file"].split("/")
        book = parts[0] if len(parts) > 1 else "misc"
        stem = re.sub(r"\.md$", "", parts[-1]).replace("_", " ")
        return [p | {"mtime": row["mtime"]} for p in parents_of(row["content"] or "", file=row["file"], book=book, chapter=stem, count=counted)]

    df = _by_rows(files.select("file", "content", F.col("mtime").cast("double").alias("mtime")), "content", rows_of, _PARENT, count)
    return df.withColumn("figure_ids", tx.figure_ids(F.col("text"))).withColumn("has_figure_ref", F.size("figure_ids") > 0)


def longform_children(parents: DataFrame, count: Counter = count_tokens) -> DataFrame:
    """TXT-14..20 over parents; a map without a shuffle."""
    need = [c.split()[0] for c in _PARENT.split(", ") if c.split()[0] != "token_count"]
    rows_of = lambda p, counted: [c | {"mtime": p["mtime"]} for c in children_of(p, counted)]
    df = _by_rows(parents.select(*need), "text", rows_of, _CHILDREN, count)
    return df.withColumn("figure_ids", tx.figure_ids(F.col("body"))).withColumn("has_figure_ref", F.size("figure_ids") > 0).drop("body")
