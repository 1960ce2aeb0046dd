"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document classifier (logistic regression in numpy on sixteen measures of the
text, their squares included) gives each document a log odds of being good. The
odds of many documents inform about the place they come from: summed over a host,
the expected number of good documents updates a Beta prior whose mean is the
corpus's and whose strength is fitted to the spread of the hosts (moments); summed
over a path of the host, it updates a Beta prior around the host's posterior mean,
its strength fitted to the spread of the paths. Sparse paths thus shrink to their
host and sparse hosts to the corpus. The decision adds the document's log odds and
the place's posterior log odds relative to the corpus, the latter weighed by
`place_weight`.

For `documents`, which have no URL, the host is the source and the path its
language section; with a URL column, host and first path segment are taken from it.

The sample of the classifier is at most `bound` labelled rows by hash order of
doc_id (a parameter; a rare class gets some more). The hierarchy counts every document. The text is read once,
by a map whose rows are staged with their evidence, and never shuffled; what is shuffled is one
row per path and partition. The posteriors are broadcast up to `max_broadcast_paths`
paths and joined with a shuffle beyond.

Defined cases: null and empty texts get the measures of an empty text and are
decided like any other; very long texts are measured whole. Odds equal to the cut are kept. A null host or path counts as a place of its own. Repeated
rows count as often as they stand there. Extra columns pass through `keep_good`.
Without labelled rows of both kinds every score is 0.5 and everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fit_in_task, labelled_sample, pieces, spare, stage, table
from corvane.llm.textkernel import SPACE, WORD, Scan, doc_shingles
from corvane.llm.toxicity import best_threshold, in_chunks

SAMPLE = 8000
_tables: dict[str, np.ndarray] = {}


def _case() -> np.ndarray:
    """1 for upper-case code points, 2 for numerals, 0 otherwise."""
    if not _tables:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            t[i] = 1 if c.isupper() else 2 if c.isnumeric() else 0
        _tables["case"] = t
    return _tables["case"]


def measures(texts: pa.Array) -> np.ndarray:
    """Eight measures of each text and their squares."""
    scan = Scan(texts)
    n_docs, start = scan.n_docs, scan.start
    chars = np.diff(start)
    doc_of = np.repeat(np.arange(n_docs), chars)
    case = _case()[scan.cps]
    share = lambda flag: np.bincount(doc_of[flag], minlength=n_docs) / np.maximum(chars, 1)
    words = np.maximum(scan.n_words, 1)
    h = scan.word_hashes()

    def repeated(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Share of a text's hashes that stood there before."""
        key = np.sort((docs.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        again = np.flatnonzero(key[1:] == key[:-1])
        n = np.bincount(docs, minlength=n_docs)
        return np.bincount((key[again] >> np.uint64(40)).astype(np.int64), minlength=n_docs) / np.maximum(n, 1)

    grams, gram_doc = doc_shingles(scan, 3, h)
    upper = case == 1
    letters = np.bincount(doc_of[scan.kind == WORD], minlength=n_docs)
    x = np.stack([
        np.log1p(scan.n_words),
        share((scan.kind != WORD) & (scan.kind != SPACE)),
        np.bincount(doc_of[upper], minlength=n_docs) / np.maximum(letters, 1),
        share(case == 2),
        np.bincount(scan.doc, weights=(scan.we - scan.ws).astype(float), minlength=n_docs) / words / 10,
        repeated(h, scan.doc),
        repeated(grams, gram_doc),
        share(scan.cps == 0x0A),
    ], axis=1)
    return np.concatenate([x, x * x], axis=1)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    threshold: float = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def train(sample: list[tuple[str, int]], ridge: float = 1.0) -> Logistic | None:
    """Iteratively reweighted least squares."""
    y = np.array([b for _, b in sample], float)
    if len(set(y)) < 2:
        return None
    x = np.concatenate([measures(pa.array(texts, pa.string())) for _, texts in in_chunks([t for t, _ in sample])])
    model = Logistic(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1))
    z = np.column_stack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(x))])
    w = model.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = p * (1 - p) + 1e-6
        hessian = (z * s[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, z.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    model.weights = w
    # best_threshold counts a false alarm twice: here an alarm is a good document rejected
    bad = 1 / (1 + np.exp(model.logit(x)))
    model.threshold = 1 - best_threshold(bad, 1 - y)
    return model


def places(docs: DataFrame, url: str | None) -> tuple[Column, Column]:
    """(host, path) expressions."""
    if url is None:
        return F.col("source").cast("string"), F.col("lang").cast("string")
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    return host, F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def posteriors(counts: DataFrame) -> DataFrame:
    """(host, path, n, good) sums to (host, path, posterior, offset): the path's mean, and its log odds above the corpus's.

    Strengths are fitted by moments: of hosts' means around the corpus's, and of paths' means around their host's.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum("n").alias("n"), F.sum("good").alias("g")).first()
    n, g = float(total["n"] or 0), float(total["g"] or 0)
    prior = min(max(g / n, 1e-4), 1 - 1e-4) if n else 0.5
    hosts = counts.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hg"))

    def strength(df: DataFrame, n: str, g: str, mean: Column) -> float:
        """Beta strength from the between-place variance left when the sampling variance is taken off."""
        m = F.col(g) / F.col(n)
        r = df.where(F.col(n) > 1).agg(
            F.sum(F.col(n) * (m - mean) ** 2).alias("ss"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(n).alias("n"), F.sum(F.col(n) * mean * (1 - mean)).alias("v"),
        ).first()
        if not r["n"]:
            return 10.0
        between = max((r["ss"] - r["noise"]) / r["n"], 1e-6)
        return float(min(max(r["v"] / r["n"] / between - 1, 1.0), 1e4))

    a = strength(hosts, "hn", "hg", F.lit(prior))
    hosts = hosts.withColumn("hp", (F.col("hg") + a * prior) / (F.col("hn") + a)).select(F.col("host").alias("h"), "hp")
    both = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = strength(both, "n", "good", F.col("hp"))
    post = (F.col("good") + b * F.col("hp")) / (F.col("n") + b)
    post = F.least(F.greatest(post, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = float(np.log(prior / (1 - prior)))
    return both.select("host", "path", F.col("n"), post.alias("posterior"), (F.ln(post / (1 - post)) - base).alias("offset"))


def score_documents(
    docs: DataFrame, model: Logistic | None, *, text: str = "text", url: str | None = None, place_weight: float = 0.3, max_broadcast_paths: int = 100_000,
    with_text: bool = True,
) -> DataFrame:
    """docs with evidence (log odds of the text), posterior (of the place), quality (0..1) and keep; without text if with_text is false."""
    spark, base = docs.sparkSession, docs.columns
    host, path, off, ev, post, quality, keep = (spare(base, c) for c in ("host__", "path__", "offset__", "evidence", "posterior", "quality", "keep"))
    if model is None:
        return docs.select("*", F.lit(0.0).alias(ev), F.lit(0.5).alias(post), F.lit(0.5).alias(quality), F.lit(True).alias(keep))
    shared = spark.sparkContext.broadcast(model)
    h, p = places(docs, url)
    out = [c for c in base if c != text or with_text]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            logit = shared.value.logit(measures(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in [*out, host, path]), pa.array(logit)], names=[*out, host, path, ev])

    kinds = T.StructType([*(docs.schema[c] for c in out), T.StructField(host, T.StringType()), T.StructField(path, T.StringType()), T.StructField(ev, T.DoubleType())])
    scored, _ = stage(docs.withColumns({host: h, path: p}).mapInArrow(evidence, kinds), "evidence")
    # fixed-point sums do not depend on the order of addition
    good = F.sum(F.round(1_000_000 / (1 + F.exp(-F.col(ev)))).cast("long")) / 1_000_000.0
    counts, _ = stage(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), good.alias("good")), "quality")
    h_, p_ = spare([*base, host, path], "place_host__"), spare([*base, host, path], "place_path__")
    table_ = posteriors(counts).select(F.col("host").alias(h_), F.col("path").alias(p_), F.col("posterior").alias(post), F.col("offset").alias(off))
    few = counts.count() <= max_broadcast_paths
    hit = scored.join(F.broadcast(table_) if few else table_.hint("shuffle_hash"), F.col(host).eqNullSafe(F.col(h_)) & F.col(path).eqNullSafe(F.col(p_)))
    odds = F.col(ev) + place_weight * F.col(off)
    cut = float(np.log(model.threshold / (1 - model.threshold)))
    return hit.select(*[F.col(c) for c in out], F.round(F.col(ev), 6).alias(ev), F.round(F.col(post), 6).alias(post), F.round(1 / (1 + F.exp(-odds)), 6).alias(quality), (odds >= cut).alias(keep))


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = SAMPLE, text: str = "text") -> Logistic | None:
    return fit_in_task(labelled_sample(docs, labels, "quality", bound, text), train)


def keep_good(docs: DataFrame, labels: DataFrame, *, bound: int = SAMPLE, text: str = "text", **options) -> DataFrame:
    """docs without those that the classifier rejects."""
    scored = score_documents(docs, fit(docs, labels, bound=bound, text=text), text=text, **options)
    return scored.where(F.col(scored.columns[-1])).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Evidence, posterior of the place, quality and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", "source", "lang", "text"), model, with_text=False).select("doc_id", "source", "lang", "evidence", "posterior", "quality", "keep")
