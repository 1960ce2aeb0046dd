"""HTML extraction by nearest-URL page differencing.

Pages of one host are ordered by URL path. A page is paired with the nearest page
before or behind it, the one whose path shares the longer prefix with its own (the one
before, if equal). The two pages' text lines are aligned by a longest common
subsequence, and the shared lines - menus, banners, footers, whatever the
template repeats - are deleted; what is left is the page's own text.

Captures of one path, and pages of the same text lines under other paths (mirrors,
session parameters), would delete each other's text; so the neighbour is the nearest
page of another path and of other lines. Of several captures of a path the one of the
smallest page_id (then of the smallest hash of lines) stands for the path. Pages without lines have no neighbour and are nobody's.

A page's text lines are its texts between block-level tags, entities decoded and
white space collapsed, without scripts, styles, comments and the head.
A head without an end tag before the body ends where its own elements (title, meta,
link, base, script, style, noscript, template) do. An unclosed noscript drops its tag only.

Where several subsequences are longest, the one is taken that the greedy walk from
the front finds (each line is matched as early as keeps the length). A page that
is alone on its host keeps all its lines.

Defined cases: null html counts as empty and gives empty text; a null or malformed
URL belongs to the host "" with the whole URL as path. Repeated rows and repeated
captures each get the same text. A null page_id is one like any other. Very long pages are
aligned by matching pairs (Hunt-Szymanski), not by a full table. Other columns are
not read. An empty table gives an empty result.

Scale: pairs are found and aligned on narrow rows, lines as 8-byte hashes, so that a page's
text (packed with zstd) is shuffled once, to its verdict. Pages are extracted twice
instead, which is cheaper than moving them. Paths are cut into ranges of host and path by a
range partitioning, whatever the size of a host and whatever its paths begin with;
neighbours across a cut come from the ends of the ranges, a few rows for each partition,
which the driver strings together.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import release, stage, table

# the rest of a tag: a ">" within quotes does not end it, unless a quote is left open
_REST = r"""(?:(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)"""
_NOSCRIPT = rf"<noscript\b{_REST}(?:(?!<noscript\b).)*?</noscript\s*>"
_TITLE = rf"<title\b{_REST}(?:(?!<title\b).)*?</title\s*>"
_DROP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template)\b{_REST}.*?(?:</\1\s*>|\Z)|" + _NOSCRIPT
    # a head up to its end tag, if that comes before a body, or else as far as its own elements go
    + rf"|<head\b{_REST}(?:(?:(?!<body\b|<head\b).)*?</head\s*>|(?:\s|<!--.*?(?:-->|\Z)|<(script|style|template)\b{_REST}.*?(?:</\2\s*>|\Z)|"
    + _NOSCRIPT + "|" + _TITLE + rf"|<(?:base|link|meta)\b{_REST})*)|<![^>]*>|<\?[^>]*>",
    re.S | re.I,
)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|button|caption|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|menu|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b"
    + _REST,
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z]" + _REST)


def text_lines(page: str | None) -> list[str]:
    """The non-empty text lines of an HTML page."""
    if not page:
        return []
    body = _TAG.sub("", _BLOCK.sub("\x00", _DROP.sub(" ", page)))
    out = (" ".join(html_lib.unescape(x).split()) for x in body.split("\x00"))
    return [x for x in out if x]


def common_lines(a: list, b: list) -> list[bool]:
    """For each item of a, whether the longest common subsequence with b holds it."""
    shared = [False] * len(a)
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        shared[lo] = True
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        shared[end_a] = True
    places: dict[object, list[int]] = {}
    for j in range(end_b - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)  # from the back
    tails: list[int] = []  # the smallest last place of a subsequence of each length
    nodes: list[tuple | None] = []  # of each length: (place in a, node of the length before)
    for i in range(lo, end_a):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            if k < len(tails) and tails[k] == j:
                continue
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        shared[node[0]] = True
        node = node[1]
    return shared


def _digest(lines: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\n".join(lines).encode("utf-8", "surrogatepass"))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, path, html) to (page_id, host, path, hash of all lines, hashes of the lines)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            pages = [text_lines(x) for x in part.column(3).to_pylist()]
            hashes = [np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in p], np.uint64).tobytes() for p in pages]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([_digest(p) for p in pages], pa.binary()), pa.array(hashes, pa.binary())], names=["page_id", "host", "path", "h", "lines"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, path, html) to (page_id, host, path, hash of all lines, packed lines)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            pages = [text_lines(x) for x in part.column(3).to_pylist()]
            packed = [pack("\n".join(p).encode("utf-8", "surrogatepass")) for p in pages]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([_digest(p) for p in pages], pa.binary()), pa.array(packed, pa.binary())], names=["page_id", "host", "path", "h", "lines"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, h, neighbour_id, own hashes, the neighbour's or null) to (host, path, h, neighbour_id, n_lines, n_shared, shared as bits)."""
    read = lambda blob: np.frombuffer(blob, np.uint64).tolist() if blob is not None else []
    for batch in batches:
        total, gone, bits = [], [], []
        for own, other in zip(map(read, batch.column(4).to_pylist()), map(read, batch.column(5).to_pylist()), strict=True):
            shared = common_lines(own, other)
            total.append(len(own))
            gone.append(sum(shared))
            bits.append(np.packbits(np.array(shared, bool)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(bits, pa.binary())],
            names=["host", "path", "h", "neighbour_id", "n_lines", "n_shared", "shared"],
        )


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, neighbour_id, n_lines, n_shared, packed lines, shared) to the page's own text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = []
            for n, blob, bits in zip(*(part.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
                lines = unpack(blob).decode("utf-8", "surrogatepass").split("\n") if n else []
                shared = np.unpackbits(np.frombuffer(bits, np.uint8), count=n) if n else []
                texts.append("\n".join(x for x, s in zip(lines, shared, strict=True) if not s))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), part.column(2), part.column(3)], names=["page_id", "neighbour_id", "text", "n_lines", "n_shared"])


def _prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings of the same host, null if b is."""
    n = F.least(F.length(a), F.length(b))
    # bisection would need a loop: paths are short, and differ in a few places
    first = F.array_position(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y), False)
    return F.when(b.isNull(), F.lit(None)).when(first > 0, first - 1).otherwise(n)


def _carried(ends: list, forward: bool) -> dict[int, tuple]:
    """For each range in order: (the last path of the ranges before it, the last one of other lines than that).

    Or, backwards, the first ones of the ranges behind. `ends` has for each range its outmost row and the one before that
    row's run of equal lines, where the range has one.
    """
    one = two = None
    out = {}
    same = lambda x, y: x is not None and (x["host"], x["h"]) == (y["host"], y["h"])
    for e in sorted(ends, key=lambda e: e["pid"], reverse=not forward):
        out[e["pid"]] = (one, two)
        outmost, inner = (e["last"], e["last_pre"]) if forward else (e["first"], e["first_pre"])
        two = inner if inner is not None else (two if same(one, outmost) else one)
        one = outmost
    return out


def _neighbours(paths: DataFrame, ranges: int | None) -> DataFrame:
    """(host, path, page_id, h), one row for each path, with before, before2, behind, behind2 of the same host (or null).

    before is the path in front, before2 the nearest one in front whose lines are not those of before; and so behind.
    """
    spark = paths.sparkSession
    me = F.struct("host", "path", "page_id", "h")
    ranged, _ = stage(paths.repartitionByRange(*([ranges] if ranges else []), "host", "path").select("host", "path", "page_id", "h", F.spark_partition_id().alias("pid")), "ranges")
    up, down = (Window.partitionBy("pid").orderBy(*order) for order in ((F.col("host"), F.col("path")), (F.col("host").desc(), F.col("path").desc())))
    same = lambda x: (x["host"] == F.col("host")) & (x["h"] == F.col("h"))

    def runs(df: DataFrame, w, near: str, pre: str) -> DataFrame:
        """near: the row in front; pre: the one in front of this row's run of equal lines, within the range."""
        df = df.withColumn(near, F.lag(me).over(w))
        start = F.when(F.col(near).isNotNull() & ~same(F.col(near)), F.col(near))
        return df.withColumn(pre, F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    known = runs(runs(ranged, up, "before", "up_pre"), down, "behind", "down_pre")
    at = F.struct("host", "path")
    ends = known.groupBy("pid").agg(F.min_by(me, at).alias("first"), F.max_by(me, at).alias("last"), F.min_by("down_pre", at).alias("first_pre"), F.max_by("up_pre", at).alias("last_pre")).collect()  # one row for each partition
    ahead, after = _carried(ends, True), _carried(ends, False)
    kind = known.schema["before"].dataType
    carried = T.StructType([T.StructField("cid", T.IntegerType()), *[T.StructField(n, kind) for n in ("c1", "c2", "d1", "d2")]])
    cuts = spark.createDataFrame([(e["pid"], *ahead[e["pid"]], *after[e["pid"]]) for e in ends], carried)
    df = known.join(F.broadcast(cuts), F.col("pid") == F.col("cid"))

    def settled(df: DataFrame, w, near: str, pre: str, c1: str, c2: str) -> DataFrame:
        """The second neighbour: what is in front of the run of the first one."""
        # the run of a range's first row may begin in a range before it
        opening = F.when(F.col(c1).isNotNull() & same(F.col(c1)), F.col(c2)).otherwise(F.col(c1))
        first = F.first(opening).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        df = df.withColumn(pre, F.coalesce(F.col(pre), first))
        return df.withColumn(near + "2", F.when(F.col(near).isNull(), F.col(c2)).otherwise(F.lag(pre).over(w))).withColumn(near, F.coalesce(near, c1))

    df = settled(settled(df, up, "before", "up_pre", "c1", "c2"), down, "behind", "down_pre", "d1", "d2")
    return df.select("host", "path", *[F.when(F.col(c)["host"] == F.col("host"), F.col(c)).alias(c) for c in ("before", "before2", "behind", "behind2")])


def difference_pages(pages: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """(page_id, neighbour_id, text, n_lines, n_shared) of every page; `ranges` of paths are sorted apart (by default as many as a shuffle's partitions)."""
    parts = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)(.*)$"
    url = F.coalesce(F.col("url"), F.lit(""))
    good = url.rlike(parts)
    host = F.when(good, F.lower(F.regexp_extract(url, parts, 1))).otherwise(F.lit(""))
    path = F.when(good, F.regexp_extract(url, parts, 2)).otherwise(url)
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html"))
    kinds = "page_id long, host string, path string, h binary, lines binary"
    # captures of a path with the same lines are one
    distinct = placed.mapInArrow(_narrow, kinds).groupBy("host", "path", "h").agg(F.min("page_id").alias("page_id"), F.first("lines").alias("lines"))
    distinct, p_distinct = stage(distinct, "pages")
    known = distinct.where(F.length("lines") > 0)
    near = _neighbours(known.groupBy("host", "path").agg(F.min(F.struct("page_id", "h")).alias("s")).select("host", "path", "s.*"), ranges)
    both = distinct.join(near, ["host", "path"], "left")
    pick = lambda c: F.when(F.length("lines") > 0, F.when(F.col(c)["h"] == F.col("h"), F.col(c + "2")).otherwise(F.col(c)))
    both = both.withColumn("before", pick("before")).withColumn("behind", pick("behind"))
    p, q = _prefix(F.col("path"), F.col("before.path")), _prefix(F.col("path"), F.col("behind.path"))
    chosen = F.when(F.coalesce(p, F.lit(-1)) >= F.coalesce(q, F.lit(-1)), F.col("before")).otherwise(F.col("behind"))
    both = both.select("host", "path", "h", "lines", chosen.alias("o")).select("host", "path", "h", F.col("o.page_id").alias("neighbour_id"), "lines", F.col("o.path").alias("op"), F.col("o.h").alias("oh"))
    other = distinct.select(F.col("host").alias("oh_"), F.col("path").alias("op_"), F.col("h").alias("oh2_"), F.col("lines").alias("other"))
    paired = both.join(other, (F.col("host") == F.col("oh_")) & (F.col("op") == F.col("op_")) & (F.col("oh") == F.col("oh2_")), "left")
    verdict = paired.select("host", "path", "h", "neighbour_id", "lines", "other").mapInArrow(_align, "host string, path string, h binary, neighbour_id long, n_lines long, n_shared long, shared binary")
    verdict, _ = stage(verdict, "verdicts")
    release(pages.sparkSession, p_distinct)
    whole = placed.mapInArrow(_texts, kinds).join(verdict, ["host", "path", "h"])
    return whole.select("page_id", "neighbour_id", "n_lines", "n_shared", "lines", "shared").mapInArrow(_delete, "page_id long, neighbour_id long, text string, n_lines long, n_shared long")


def op5_html_differencing(spark, sf_dir: str) -> DataFrame:
    """The own text of every page."""
    return difference_pages(table(spark, sf_dir, "pages"))
