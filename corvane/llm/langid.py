"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: row i of a single table holds,
as the bits of one or more integers, which languages have bit i set. The AND of the rows at
an n-gram's `K` places is the set of all languages that contain the n-gram, in
one look-up whatever the number of languages. A text's n-grams are looked up, the
bits are counted per language, the counts are corrected for the filter's false
positives ((hits - f n) / (1 - f), f the language's measured rate) and the
language of the highest corrected share decides.

An n-gram is 3 or 4 characters of a folded word with a boundary mark on either
side, weighed alike. A language's filter holds the n-grams found in at least
`min_texts` of its sample texts, and in a share of them that is at least
`least_rate` of the share in the language that has the n-gram most often.

(This is narrower than "contained at all": a wrongly labelled text would else bring its n-grams into a
filter they do not belong to. `least_rate=0` turns it off.)

The sample is at most `bound` labelled documents, by hash order of the id, and up to `LEAST` of each
language beyond; the filters (`1 << ROWS` masks of 8 bytes for each 64 languages)
are broadcast and grow with the number of languages, not with the corpus. Scoring is
one map over the documents without a shuffle; very long texts are looked up whole.

Defined cases: a text without words, null texts included, gets the language
"und", share 0 and no n-grams; so does any text if there are no labelled rows.
Equal shares go to the language first in alphabetical order. Null labels are not
learned from. Repeated rows are each answered alike; an id that is repeated counts once in
the sample, by its smallest text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import fit_in_task, pieces, table
from corvane.llm.textkernel import Scan, mix
from corvane.llm.toxicity import in_chunks

ROWS, K = 21, 3
GRAMS = (3, 4)
SAMPLE = 8000
LEAST = 200  # documents of any language that the sample gets even if it is rare


def grams(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every n-gram; words shorter than an n-gram, boundaries included, give none of it."""
    hashes, owner = [], []
    for n in GRAMS:
        count = np.maximum(scan.we - scan.ws + 3 - n, 0)
        own = np.repeat(np.arange(len(scan.ws)), count)
        lo = scan.ws[own] - 1 + (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
        hi = lo + n
        left, right = lo < scan.ws[own], hi > scan.we[own]
        h = scan.span_hash(np.where(left, lo + 1, lo), np.where(right, hi - 1, hi))
        hashes.append(mix(h + np.uint64(n) + (left.astype(np.uint64) << np.uint64(20)) + (right.astype(np.uint64) << np.uint64(21))))
        owner.append(scan.doc[own])
    return np.concatenate(hashes), np.concatenate(owner)


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  # (1 << ROWS, words of a mask)
    false_rate: np.ndarray  # by language

    @classmethod
    def build(cls, sample: list[tuple[str, str]], min_texts: int = 2, least_rate: float = 0.1) -> Filters | None:
        languages = sorted({lang for _, lang in sample})
        if not languages:
            return None
        counted = []
        for lang in languages:
            texts = [t for t, x in sample if x == lang]
            all_, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, part_texts in in_chunks(texts):  # counts are merged part by part: memory follows the distinct n-grams
                scan = Scan(pa.array(part_texts, pa.string()), solo=False)
                h, doc = grams(scan)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
                part, times = np.unique(h[new], return_counts=True)
                all_, inverse = np.unique(np.concatenate([all_, part]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([n, times]), minlength=len(all_)).astype(np.int64)
            counted.append((all_, n, len(texts)))
        # a wrongly labelled text brings n-grams of another language: those are far rarer here than there
        union = np.unique(np.concatenate([c[0] for c in counted]))
        most = np.zeros(len(union))
        for all_, n, texts_ in counted:
            at = np.searchsorted(union, all_)
            most[at] = np.maximum(most[at], n / texts_)
        rows = np.zeros((1 << ROWS, -(-len(languages) // 64)), np.uint64)
        for k, (all_, n, texts_) in enumerate(counted):
            known = all_[(n >= min(min_texts, texts_)) & (n / texts_ >= least_rate * most[np.searchsorted(union, all_)])]
            for at in cls.places(known):
                rows[at, k // 64] |= np.uint64(1 << k % 64)
        bits = np.array([((rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, rows, bits**K)

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        """The K rows of each hash: disjoint stretches of its bits."""
        return [((h >> np.uint64(43 - 21 * j)) & np.uint64((1 << ROWS) - 1)).astype(np.int64) for j in range(K)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        first, *more = self.places(h)
        out = self.rows[first]
        for at in more:
            out &= self.rows[at]
        return out

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, its corrected share, number of n-grams) of each text."""
        scan = Scan(texts, solo=False)
        h, doc = grams(scan)
        masks, n = self.masks(h), np.bincount(doc, minlength=scan.n_docs)
        share = np.zeros((len(self.languages), scan.n_docs))
        for k in range(len(self.languages)):
            hits = np.bincount(doc[((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)], minlength=scan.n_docs)
            f = self.false_rate[k]
            share[k] = np.clip((hits - f * n) / (1 - f) / np.maximum(n, 1), 0, 1) if f < 1 else 0
        best = np.round(share, 6).argmax(0)
        return np.where(n > 0, best, -1), np.where(n > 0, share[best, np.arange(scan.n_docs)], 0), n


def fit(docs: DataFrame, *, bound: int = SAMPLE, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Filters | None:
    labelled = docs.select(F.col(id_col).alias("id__"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("id__ IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    # a document repeated in many rows is one, of its smallest language
    known = labelled.groupBy("id__").agg(F.min("l").alias("l"))
    order = (F.xxhash64("id__"), F.col("id__"))
    some = known.orderBy(*order).limit(bound)
    # each task sends at most LEAST rows of a language
    each = known.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(*order))).where(F.col("k") <= LEAST).drop("k")
    pick = some.union(each).select(F.col("id__").alias("pick__")).distinct()
    sample = labelled.join(F.broadcast(pick), F.col("id__") == F.col("pick__")).groupBy("id__").agg(F.min("t").alias("t"), F.min("l").alias("l"))
    return fit_in_task(sample.repartition(1).sortWithinPartitions(*order).select("t", "l"), Filters.build)


def identify(docs: DataFrame, filters: Filters | None, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, language, share, n_grams) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            m = model.value
            if m is None:
                k = batch.num_rows
                found, share, n = np.full(k, -1), np.zeros(k), np.zeros(k, np.int64)
            else:
                found, share, n = m.decide(batch.column(1))
            names = [m.languages[i] if i >= 0 else "und" for i in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(share, 6)), pa.array(n.astype(np.int64))], names=["doc_id", "language", "share", "n_grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, language string, share double, n_grams long")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
