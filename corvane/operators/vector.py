"""Exact vector search (KNN-*): cosine top-k as one scan and a bounded sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


CELLS = 4_000_000  # distances of a batch that are held at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a vector without direction. Norms of columns named *_norm may be stored to save work."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - dot(a, b) / scale).otherwise(F.lit(1.0))


def similarity(distance: Column) -> Column:
    """KNN-2: 1 - distance, at least 0, four decimals."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance), 4)


def normalise(v: Column) -> Column:
    """KNN-5: length 1; a zero or NaN length leaves the vector."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n), F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def top_k(rows: DataFrame, query: Sequence[float], k: int, *, vec: str = "vector", key: str = "id", where: Column | None = None) -> DataFrame:
    """KNN-1: the k nearest rows by cosine distance (ties by key), with distance; the filter is applied before the search.

    Column pruning leaves vector and payload to the scan; the limit is kept per partition and merged, without a full sort.
    """
    df = rows.where(where) if where is not None else rows
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", cosine_distance(F.col(vec), q)).orderBy(F.round("distance", 12), key).limit(k)


def top_k_by_example(rows: DataFrame, example: DataFrame, k: int, *, vec: str = "vector", key: str = "id") -> DataFrame:
    """KNN-4: like top_k, the query being the one row of `example` (column query); the example is one row by construction."""
    one = example.select(F.col("query")).limit(1)
    return rows.crossJoin(F.broadcast(one)).withColumn("distance", cosine_distance(F.col(vec), F.col("query"))).drop("query").orderBy(F.round("distance", 12), key).limit(k)


def top_k_many(rows: DataFrame, queries: DataFrame, k: int, *, vec: str = "vector", key: str = "id", max_broadcast: int = 10_000) -> DataFrame:
    """KNN-1 for a table of queries (qid, query): each query's k nearest rows, with distance and rank, in one pass over the rows.

    A batch of rows is compared with all queries by one matrix product and passes on only what may still be among the k
    nearest, so that what is shuffled is k rows for each query and batch. The queries are broadcast up to max_broadcast
    (checked); more of them are taken in that many at a time.
    """
    n = queries.count()
    parts = max(1, -(-n // max_broadcast))
    kind, names = queries.schema["qid"], [c for c in rows.columns if c != vec]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("qid", kind.dataType), T.StructField("distance", T.DoubleType())])
    found = None
    for p in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p)
        near = rows.select(*names, vec).mapInArrow(_nearest(mine.select("qid", "query").toArrow(), k, names, kind), schema)
        found = near if found is None else found.unionByName(near)
    w = Window.partitionBy("qid").orderBy(F.round("distance", 12), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(queries: pa.Table, k: int, names: list[str], kind: T.StructField):
    qids, q = queries.column("qid").combine_chunks(), np.array(queries.column("query").to_pylist(), np.float64)
    scale = np.sqrt(np.square(q).sum(1)) if len(q) else np.zeros(0)

    def run(batches):
        for batch in batches:
            vectors = batch.column(len(names)).to_pylist()
            fit = np.array([i for i, v in enumerate(vectors) if v is not None and len(q) and len(v) == q.shape[1]], np.int64)
            if not len(fit):
                continue
            x = np.array([vectors[i] for i in fit], np.float64)
            length, kth = np.sqrt(np.square(x).sum(1)), min(k, len(x)) - 1
            step = max(1, CELLS // len(x))
            for lo in range(0, len(q), step):
                size = scale[lo : lo + step, None] * length
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = np.where(size > 0, 1 - (q[lo : lo + step] @ x.T) / size, 1.0)
                # ties at the k-th place all pass: the key decides later
                last = np.partition(d, kth, axis=1)[:, kth]
                j, i = np.nonzero(d <= last[:, None] + 1e-11)
                cols = [batch.column(c).take(pa.array(fit[i])) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, qids.take(pa.array(j + lo)), pa.array(d[j, i])], names=[*names, "qid", "distance"])

    return run


def over_fetch(profile: str, n: int) -> int:
    """KNN-3: how many rows to fetch for n results."""
    return {"api": 3 * n, "tool": min(5 * n, 100), "longform": 10 * n, "similar": max(3 * n, 40), "chat": 3 * n, "chat_longform": 5 * max(5, n)}[profile]


Embedder = Callable[[pd.Series], pd.Series]


def hashing_embedder(dim: int = 64, kind: str = "float32") -> Embedder:
    """A stand-in for an embedding model: signed word hashes, length 1, as numbers of `kind` (deterministic, no model file)."""

    def embed(texts: pd.Series) -> pd.Series:
        import hashlib
        import re

        import numpy as np

        def one(t: str | None) -> list[float] | None:
            if t is None:
                return None
            v = np.zeros(dim)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(kind).tolist()

        return texts.map(one)

    return embed


def embed_batches(df: DataFrame, embedder: Embedder, *, text: str = "text", out: str = "vector", batch: int = 64, cut: int = 4000, tries: int = 1, with_error: bool = False, element: T.DataType = T.FloatType()) -> DataFrame:
    """KNN-6/7: vectors of `element` by Arrow batches; a failing batch is retried, then done text by text, cut to `cut` characters.

    What fails alone, or comes back with NaN, has a null vector and (with_error) its message.
    """
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(element))] + ([T.StructField("error", T.StringType())] if with_error else []))

    def good(v) -> bool:
        return v is not None and all(x == x for x in v)

    def run(frames):
        for frame in frames:
            vectors, errors = [], []
            for lo in range(0, len(frame), batch):
                part = frame[text].iloc[lo : lo + batch]
                got = None
                for _ in range(tries):
                    try:
                        got = list(embedder(part))
                        break
                    except Exception:  # noqa: BLE001 - the model's own; each text gets its turn below
                        got = None
                for i, t in enumerate(part):
                    v, e = (got[i], None) if got is not None and good(got[i]) else (None, None)
                    if v is None:
                        try:
                            v = embedder(pd.Series([t[:cut] if t is not None else None])).iloc[0]
                            v, e = (v, None) if good(v) else (None, "no finite vector")
                        except Exception as x:  # noqa: BLE001
                            v, e = None, str(x)[:200]
                    vectors.append(v), errors.append(e)
            yield frame.assign(**{out: vectors} | ({"error": errors} if with_error else {}))

    return df.mapInPandas(run, schema)


LONGFORM_INSTRUCTION = "Instruct: find passages of the library that answer the question\nQuery: "


def query_text(q: Column, *, longform: bool = False) -> Column:
    """KNN-8: the query as it is embedded."""
    return F.concat(F.lit(LONGFORM_INSTRUCTION), q) if longform else q
