"""Embedding near-dedup: an exact metric range join.

Vectors are scaled to length 1, where a cosine similarity of s is a Euclidean
distance of sqrt(2 - 2 s); pairs within that radius r are wanted. Every vector's
home is the cell of its nearest pivot. If y is within r of x, then by the triangle
inequality y's distance to its own pivot p is at least d(x, p) - r and, p being
y's nearest, d(x, p) <= d(x, home pivot of x) + 2 r. So x is copied to every cell
whose pivot is within d(home) + 2 r of it and whose own radius R reaches it,
d(x, p) <= R + r; among them only those also count whose bisecting plane with
the home is within r (which follows from the same inequality in Euclidean space).
Each cell compares its residents with each other and with the copies, without
regard to other cells. A pair of two homes is found in the lower-numbered one, so
copies go to lower cells only. The result is exact.

Pivots are spread by a greedy farthest-first choice from a sample bounded by their
number, which grows as the square root of the number of vectors (`pivots_per_root`
to a root), and so does what is broadcast. They choose speed only, never the
result. How much they save depends on the vectors: clusters further apart than r are
never compared, but vectors spread evenly over many dimensions are about as far from
all pivots, and nearly every cell then gets a copy (see the README for figures).

The result has a row for each vector: its class, the connected component of the links,
and the number of its links. Equal vectors collapse into one with their number as weight;
a cell's task counts the links of each row and sends a tree for each component it
sees, never the pairs themselves, so that what leaves a dense cell is in proportion to its rows.

Defined cases: a vector that is null, empty, of zero length, or holds a null, NaN or
infinite entry has no direction and no row in the result. Vectors of different dimension
are never compared: each dimension is joined apart. Null ids are left out. A repeated
id counts once, by the vector that is first by dimension and bytes. A pair at exactly the
threshold is linked. Vectors of high dimension are compared whole. The class's name is its smallest id.
Other columns are not read; an empty table gives an empty result.

Scale: pivots are broadcast; vectors are shuffled once to collapse copies and once to their
cells, as 4-byte floats. A cell is compared in rectangles of `block` residents by
4 * `block` residents or copies, each a task's work, so that a dense cell spreads
over the cluster and a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.chosen_path import components, stars
from corvane.llm.common import release, stage, table


def rows_of(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (ids, vectors as given) of the rows that have an id and a direction."""
    ids, col = batch.column(0), batch.column(1)
    off = col.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    values = col.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    there = (ids.is_valid().to_numpy(zero_copy_only=False)) & col.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    found = {}
    for dim in np.unique(size[there]):
        at = np.flatnonzero(there & (size == dim))
        x = values[off[at][:, None] + np.arange(dim)]
        n = np.square(x.astype(np.float64)).sum(1)
        good = np.isfinite(n) & (n > 0)
        if good.any():
            found[int(dim)] = number[at[good]], x[good]
    return found


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a float matrix as binary values."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The matrix of binary values of one dimension."""
    if not len(column):
        return np.zeros((0, dim), np.float32)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.float32, len(column) * dim, begin).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.square(x).sum(1)[:, None] + np.square(p).sum(1) - 2 * x @ p.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the first row."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        k = int(far.argmax())
        if far[k] <= 1e-12:
            break
        chosen.append(k)
        far = np.minimum(far, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


def vector_classes(
    vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", pivots_per_root: float = 1 / 16, n_pivots: int | None = None, block: int = 32768,
) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector: links are the other vectors of cosine similarity threshold or more."""
    spark = vectors.sparkSession
    if not -1 <= threshold <= 1:
        raise ValueError("a cosine is within -1..1")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    sizes = rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0").collect()
    pivots: dict[int, np.ndarray] = {}
    for s in sizes:
        want = n_pivots or max(1, int(np.ceil(s["n"] ** 0.5 * pivots_per_root)))
        # pivots come from a sample bounded by their number: they set the speed, not the result
        some = rows.where(F.size("v") == s["dim"]).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(want * 8).toArrow()
        got = [rows_of(b)[s["dim"]][1] for b in some.to_batches() if s["dim"] in rows_of(b)]
        # a sample without a direction leaves an arbitrary pivot
        pivots[s["dim"]] = choose_pivots(unit(np.concatenate(got)), want) if got else np.eye(1, s["dim"])
    shared = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (ids, x) in rows_of(batch).items():
                d = distances(unit(x), shared.value[dim])
                home = d.argmin(1)
                cols = [pa.array(ids), pa.array(np.full(len(ids), dim, np.int32)), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(ids)), home]), packed(x)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "dim", "cell", "d", "x"])

    home, p_home = stage(rows.mapInArrow(homes, "id long, dim int, cell int, d double, x binary").withColumn("h", F.unhex(F.md5("x"))), "homes")
    known = home
    if not home.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        known = home.groupBy("id").agg(F.min(F.struct("dim", "x", "h", "cell", "d")).alias("s")).select("id", "s.*")
    members, p_members = stage(known.select("id", "dim", "h"), "members")
    # equal vectors are one, of their number's weight
    reps, p_reps = stage(known.groupBy("dim", "h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("cell").alias("cell"), F.first("d").alias("d"), F.first("x").alias("x")), "vectors")
    cells = reps.groupBy("dim", "cell").agg(F.max("d").alias("r")).collect()  # one row for each pivot
    reach = spark.sparkContext.broadcast({(r["dim"], r["cell"]): r["r"] for r in cells})

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in its own cell (own true) and in the lower ones that its partners may be at home in."""
        for batch in batches:
            dims, cell, d = (batch.column(i).to_numpy() for i in (1, 2, 3))
            take, where = [np.arange(len(dims))], [cell]
            for dim in np.unique(dims):
                p, at = shared.value[int(dim)], np.flatnonzero(dims == dim)
                x = unit(unpacked(batch.column(4).take(pa.array(at)), int(dim)))
                dist, home_d = distances(x, p), d[at][:, None]
                plane = (dist**2 - home_d**2) / (2 * np.maximum(distances(p, p)[cell[at]], 1e-9))
                limit = np.array([reach.value.get((int(dim), j), -np.inf) for j in range(len(p))])
                go = (dist <= home_d + 2 * radius) & (dist <= limit + radius) & (plane <= radius) & (np.arange(len(p)) < cell[at][:, None])
                i, j = np.nonzero(go)
                take.append(at[i]), where.append(j)
            t = pa.array(np.concatenate(take))
            own = np.concatenate([np.ones(len(dims), bool), np.zeros(len(t) - len(dims), bool)])
            cols = [batch.column(0).take(t), batch.column(1).take(t), pa.array(np.concatenate(where).astype(np.int32)), pa.array(own), batch.column(4).take(t), batch.column(5).take(t)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "dim", "cell", "own", "x", "w"])

    placed, p_placed = stage(reps.select("id", "dim", "cell", "d", "x", "w").mapInArrow(copies, "id long, dim int, cell int, own boolean, x binary, w long"), "cells")
    # rectangles of a cell: residents in `lefts` parts by all its rows in `rights` parts
    per_cell = placed.groupBy("dim", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("own") / block)).cast("int").alias("lefts"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (4 * block))).cast("int").alias("rights"),
    )
    h = F.xxhash64("id")
    cut = placed.join(F.broadcast(per_cell), ["dim", "cell"])  # one row for each pivot
    cut = cut.withColumn("l", F.pmod(h, F.col("lefts")).cast("int")).withColumn("r", F.pmod(F.xxhash64(h), F.col("rights")).cast("int"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: F.struct(k.alias("lo"), F.col("r").alias("hi")))
    as_left = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda k: F.struct(F.col("l").alias("lo"), k.alias("hi")))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    spread = cut.withColumn("to", F.explode(F.array_union(as_right, as_left))).select("id", "dim", "cell", "own", "l", "r", F.col("to.lo").alias("lo"), F.col("to.hi").alias("hi"), "x", "w")

    def compare(key, group):
        """Rows (id, other, n): the links that the rectangle adds to an id, or, where n is 0, an edge of a component's tree."""
        dim, _, lo, hi = (k.as_py() for k in key)
        group = group.combine_chunks()
        ids, own, w = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "own", "w"))
        x = unpacked(group.column("x").combine_chunks(), dim)
        u = unit(x).astype(np.float32)
        left, right = np.flatnonzero(own & (group.column("l").to_numpy() == lo)), np.flatnonzero(group.column("r").to_numpy() == hi)
        links, trees = np.zeros(len(ids), np.int64), []
        for k in range(0, len(left), 256):
            for m in range(0, len(right), 16384):
                s = u[left[k : k + 256]] @ u[right[m : m + 16384]].T
                i, j = np.nonzero(s >= threshold - 1e-4)
                s = s[i, j]
                i, j = left[k : k + 256][i], right[m : m + 16384][j]
                # a pair of two residents stands in two rectangles, or twice in one
                ok = (i != j) & (~own[j] | (ids[i] < ids[j]))
                i, j, s = i[ok], j[ok], s[ok]
                doubt = np.flatnonzero(s < threshold + 1e-4)
                sure = np.ones(len(i), bool)
                for at in np.array_split(doubt, len(doubt) // 32768 + 1):
                    sure[at] = np.einsum("ij,ij->i", unit(x[i[at]]), unit(x[j[at]])) >= threshold
                i, j = i[sure], j[sure]
                if len(i):
                    links += np.bincount(i, weights=w[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=w[i], minlength=len(ids)).astype(np.int64)
                    trees.append(stars(ids[i], ids[j]))
        v, root = stars(*(np.concatenate(z) for z in zip(*trees, strict=True))) if trees else (ids[:0], ids[:0])
        hang, some = v != root, links > 0
        one, n = np.concatenate([ids[some], v[hang]]), np.concatenate([links[some], np.zeros(hang.sum(), np.int64)])
        other = pa.array(np.concatenate([ids[some], root[hang]]))
        return pa.table({"id": pa.array(one, pa.int64()), "other": other.cast(pa.int64()), "n": pa.array(n, pa.int64())})

    found, p_found = stage(spread.groupBy("dim", "cell", "lo", "hi").applyInArrow(compare, "id long, other long, n long"), "found")
    release(spark, p_home, p_placed)
    roots, _ = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    each = reps.select("dim", "h", "id", "w").join(counts, "id", "left").join(roots, "id", "left").select(
        "dim", "h", F.coalesce("root", "id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return members.join(each, ["dim", "h"]).select(F.col("id").alias("vec_id"), "class_id", "n_links")


def op9_embedding_range_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every embedding, at a cosine similarity of 0.95."""
    return vector_classes(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
reached AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.id),
classes AS (SELECT id, min(root) AS class_id FROM reached GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, class_id, coalesce(n, 0) AS n_links FROM classes LEFT JOIN counts ON a = id
"""
