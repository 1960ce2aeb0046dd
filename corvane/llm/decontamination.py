"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are folded runs of letters, marks and numbers, so punctuation, case, line
breaks and separators do not hide a passage. Every window of `n` words of every
text is hashed and looked up; each hit is verified word by word. Words inside a
verified window are flagged. In scripts without spaces a letter is a word of the window but
stands for a half (Han, kana) or a quarter (Thai and the like) of one: a run of flagged words counts if
it stands for as many words as its window has, so 16 Han characters or 32 Thai letters are needed where others need 8 words. A text of which more than `drop_share` is flagged is
removed; otherwise each flagged run is cut out, from its first word to the word
after it (so the separators behind it go too).

Defined cases: null and empty texts hold no words and are kept as they are; very long texts are scanned whole. A
test item of fewer than `n` words is looked up whole if it has `min_words` or
more, and ignored below. Null items are ignored; an empty benchmark changes
nothing. Repeated rows are each treated alike. Extra columns pass through; the
column `n_chars`, where there is one, is counted anew for trimmed texts.

Scale: the map side reads documents once and shuffles nothing. The hash set holds
the benchmark alone, and is broadcast in slices of at most `max_set_words` words;
a larger benchmark is scanned slice by slice, with the flags staged in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import pieces, release, spare, stage
from corvane.llm.textkernel import Scan, shingle_hashes

BITS = 22


class NgramSet:
    """The test n-grams of some lengths: a bitmap to rule out, sorted hashes to find, words to verify."""

    def __init__(self, items: list[str], n: int, min_words: int) -> None:
        grams: dict[int, dict[int, set[str]]] = {}
        if items:
            scan = Scan(pa.array(items, pa.string()))
            words = scan.word_hashes()
            for i in range(scan.n_docs):
                lo, hi = scan.first[i], scan.first[i + 1]
                size = min(n, int(hi - lo))
                if size < min(n, min_words):
                    continue
                text = scan.words(lo, hi)
                for k, h in enumerate(shingle_hashes(words[lo:hi], size)):
                    grams.setdefault(size, {}).setdefault(int(h), set()).add(" ".join(text[k : k + size]))
        self.grams = grams
        self.sorted = {size: np.array(sorted(g), np.uint64) for size, g in grams.items()}
        self.bitmap = {}
        for size, known in self.sorted.items():
            self.bitmap[size] = np.zeros(1 << BITS, bool)
            self.bitmap[size][(known >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def flagged(self, scan: Scan) -> np.ndarray:
        """For each word of the scan, whether a verified window covers it."""
        words, flags, share = scan.word_hashes(), np.zeros(len(scan.ws), bool), scan.weights()
        for size, known in self.sorted.items():
            h = shingle_hashes(words, size)
            if not len(h):
                continue
            at = np.flatnonzero(self.bitmap[size][(h >> np.uint64(64 - BITS)).astype(np.int64)])
            at = at[scan.doc[at] == scan.doc[at + size - 1]]
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            at = at[known[place] == h[at]]
            hit = np.zeros(len(scan.ws) + 1, np.int32)
            for k in at:
                if " ".join(scan.words(k, k + size)) in self.grams[size][int(h[k])]:
                    hit[k] += 1
                    hit[k + size] -= 1
            found = np.cumsum(hit[:-1]) > 0
            if found.any() and (share[found] < 1).any():
                new = np.append(True, (found[1:] != found[:-1]) | (scan.doc[1:] != scan.doc[:-1]))
                run = np.cumsum(new) - 1
                found &= np.bincount(run, weights=share)[run] >= size
            flags |= found
        return flags


def trimmed(scan: Scan, i: int, flags: np.ndarray) -> str:
    """Text i without its flagged runs."""
    lo, hi = scan.first[i], scan.first[i + 1]
    at = np.append(scan.ws[lo:hi], scan.start[i + 1])
    f = flags[lo:hi]
    out, begin = [], scan.start[i]
    for k in np.flatnonzero(f):
        if begin < at[k]:
            out.append(scan.slice(begin, at[k]))
        begin = at[k + 1]
    out.append(scan.slice(begin, scan.start[i + 1]))
    return "".join(out)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", n: int = 8, min_words: int = 5,
    drop_share: float = 0.5, max_set_words: int = 4_000_000, count_column: str | None = None,
) -> DataFrame:
    """docs without benchmark passages; count_column, if named, gets the number of flagged words (0: untouched)."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("t")).alias("s")).first()["s"] or 0
    slices = max(1, -(-size // (max_set_words * 4)))  # a word and its separator are four characters at least, for nearly all texts
    carried = spare(docs.columns, "flags__")
    paths: list[str] = []
    current = docs
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(slices)) == k)
        known = sc.broadcast(NgramSet([r["t"] for r in part.collect()], n, min_words))
        last = k == slices - 1
        current = _pass(current, docs.schema, known, text, carried, first=k == 0, last=last, drop_share=drop_share, count_column=count_column)
        if not last:
            current, path = stage(current, "decontaminate")
            paths.append(path)
            if len(paths) > 1:
                release(spark, paths.pop(0))
    return current


def _pass(df: DataFrame, base: T.StructType, known, text: str, carried: str, *, first: bool, last: bool, drop_share: float, count_column: str | None) -> DataFrame:
    names = [f.name for f in base]
    n_chars = "n_chars" if "n_chars" in names and text != "n_chars" else None
    schema = T.StructType(list(base))
    if not last:
        schema.add(carried, T.ArrayType(T.IntegerType()))
    elif count_column:
        schema.add(count_column, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            col = batch.column(batch.schema.get_field_index(text))
            scan = Scan(col)
            flags = known.value.flagged(scan)
            if not first:
                earlier = batch.column(batch.schema.get_field_index(carried))
                for i, at in enumerate(earlier.to_pylist()):
                    flags[scan.first[i] + np.array(at or [], np.int64)] = True
            count = np.bincount(scan.doc[flags], minlength=scan.n_docs)
            data = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            if not last:
                at = [np.flatnonzero(flags[scan.first[i] : scan.first[i + 1]]).tolist() for i in range(scan.n_docs)]
                yield pa.RecordBatch.from_arrays([*data.values(), pa.array(at, pa.list_(pa.int32()))], names=[*names, carried])
                continue
            touched = np.flatnonzero(count)
            keep = count <= drop_share * scan.n_words
            if len(touched):
                texts = col.to_pylist()
                for i in touched[keep[touched]]:
                    texts[i] = trimmed(scan, i, flags)
                data[text] = pa.array(texts, col.type)
                if n_chars:
                    sizes = data[n_chars].to_pylist()
                    for i in touched[keep[touched]]:
                        sizes[i] = len(texts[i])
                    data[n_chars] = pa.array(sizes, data[n_chars].type)
            if count_column:
                data[count_column] = pa.array(count, pa.int64())
            out = pa.RecordBatch.from_arrays(list(data.values()), names=list(data))
            yield out if keep.all() else out.filter(pa.array(keep))

    return df.mapInArrow(run, schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The whole documents table without passages of the benchmark; flagged_words tells what each text lost."""
    from corvane.llm.common import table

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), count_column="flagged_words")


_WORD = r"[\p{L}\p{M}\p{N}]+"
#: The same, in DuckDB: pieces are a word with the separators behind it; n = 8, min_words = 5, drop_share = 0.5.
ORACLE = rf"""
WITH b0 AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w)) AS w FROM b0),
grams AS (
  SELECT DISTINCT least(8, len(w)) AS size, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS gram
  FROM (SELECT w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) >= 5)),
sizes AS (SELECT DISTINCT size FROM grams),
d AS (
  SELECT row_number() OVER () AS r, *, regexp_extract_all(coalesce(text, ''), '{_WORD}[^\p{{L}}\p{{M}}\p{{N}}]*') AS pieces,
    list_transform(regexp_extract_all(coalesce(text, ''), '{_WORD}'), lambda w: lower(w)) AS w
  FROM documents),
windows AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, size, i FROM windows SEMI JOIN grams USING (size, gram)),
flags AS (SELECT r, list(DISTINCT k) AS ks, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
j AS (
  SELECT d.*, coalesce(flags.n, 0) AS n, CASE WHEN flags.n IS NULL THEN text ELSE
    regexp_extract(text, '^[^\p{{L}}\p{{M}}\p{{N}}]*') || array_to_string(list_filter(pieces, lambda p, k: NOT list_contains(ks, k)), '') END AS cleaned
  FROM d LEFT JOIN flags USING (r))
SELECT doc_id, cleaned AS text, lang, source, CASE WHEN n = 0 THEN n_chars ELSE length(cleaned) END AS n_chars, n AS flagged_words
FROM j WHERE n <= 0.5 * len(w)
"""
