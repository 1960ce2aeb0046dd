"""MinHash near-dedup by chosen-path set similarity join.

A text is the set of its `shingle`-word shingles, sketched by 64 minwise values
and the last bytes of 128 more.
Several trees branch the documents: a node of a tree picks `branches`
coordinates, and a document goes on to the child named by its own minwise value
at each. Nodes of at most `leaf` documents are compared exhaustively; larger ones
branch again, each at coordinates of its own that its path has not used, until
they are small, stop shrinking (a child keeps 70 % of its parent: their documents
are alike throughout) or reach the last level. What is then still large is compared
in blocks (see below). All trees share the 64 coordinates: a pair of similarity J agrees on a of them, a
binomial number, and given a, a tree brings the pair to depth d with probability
f(d, a) (`_given`). `trees_for` adds trees until the mean of 1 - (1 - f)^trees over
a reaches the target recall at the threshold and at the last level's depth.

Sketches only propose. Pairs well above the threshold (three standard errors)
link at once; pairs within three standard errors of it are decided by the exact
Jaccard similarity of their shingle sets, unless the sure links already join
them. Groups are the connected components of the links; a task sends a tree of
its sure links, never all pairs of alike documents.

A large node is cut into blocks of `block` documents, each searched by one task
from document to document, which takes one round where all are alike. The
components of all links so far then tell which documents are not in the node's
largest component; these alone are compared with every block of the node,
rectangle by rectangle, so that no pair of unjoined documents stays uncompared,
no task holds more than five blocks, and alike documents cost no comparison of all pairs.

Scale: texts are read once for sketches (and once more, for the undecided pairs
alone, by a semi-join). Exact copies collapse first, by a 128-bit hash of their
words, so that a thousand copies cost one sketch. What is shuffled per level is
(node, id) rows of 32 bytes; sketches travel only to nodes that branch, and once to all leaves.

Defined cases: null and empty texts, and texts without words, have no shingles
and belong to no group. A text shorter than a shingle is one shingle of all its
words. A very long text is sketched whole. Rows with a null id are in no group. Rows that repeat an id count as one
document, by its smallest text. The group's name is its smallest id, so ties
have one outcome. Extra columns are ignored by `near_groups` and pass through
`drop_near_duplicates`. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvane.llm.common import pieces, release, spare, stage
from corvane.llm.textkernel import Scan, doc_shingles, mix

COORDS, BYTES = 64, 128  # minwise values kept whole, for branching, and as their last byte, to estimate similarity
LEVELS = 7
_MULT = (mix(np.arange(1, COORDS + BYTES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
MAX_BROADCAST_IDS = 4_000_000  # ids of undecided documents that are broadcast; more are joined by a shuffle of the texts
_WIDTH = COORDS + BYTES // 4  # 32-bit columns of a sketch


@cache
def _given(agree: int, coords: int, branches: int, depth: int) -> float:
    """Chance that one tree brings a pair together at the given depth, if it agrees on `agree` of `coords` unused coordinates."""
    if not depth:
        return 1.0
    if not agree:
        return 0.0
    f = _given(agree - 1, coords - 1, branches, depth - 1)
    picks = range(max(0, branches - coords + agree), min(agree, branches) + 1)
    return sum(comb(agree, i) * comb(coords - agree, branches - i) * (1 - (1 - f) ** i) for i in picks) / comb(coords, branches)


def survival(j: float, branches: int, depth: int, trees: int = 1) -> float:
    """Chance that at least one of the trees brings a pair of similarity j together at the given depth."""
    chance = [comb(COORDS, a) * j**a * (1 - j) ** (COORDS - a) for a in range(COORDS + 1)]
    return sum(p * (1 - (1 - _given(a, COORDS, branches, depth)) ** trees) for a, p in enumerate(chance))


def trees_for(j: float, branches: int, recall: float, depth: int = LEVELS) -> int:
    n = 1
    while survival(j, branches, depth, n) < recall:
        n += 1
    return n


def sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, two hashes of the words in order, 64 minwise values); texts without words go."""
    for batch in pieces(batches, "t__"):
        scan = Scan(batch.column(1))
        words = scan.word_hashes()
        h, doc = doc_shingles(scan, shingle, words)
        have = np.flatnonzero(scan.n_words > 0)
        if not len(have):
            continue
        begin = np.searchsorted(doc, have)
        sig = np.empty((len(have), _WIDTH), np.uint32)
        tail = sig[:, COORDS:].view(np.uint8)
        for k in range(COORDS + BYTES):
            least = np.minimum.reduceat(((h * _MULT[k]) >> np.uint64(32)).astype(np.uint32), begin)
            if k < COORDS:
                sig[:, k] = least
            else:
                tail[:, k - COORDS] = least & np.uint32(255)
        place = (np.arange(len(words)) - scan.first[scan.doc]).astype(np.uint64)
        first = scan.first[have]
        a = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), first)
        b = np.add.reduceat(mix(words ^ mix(place + np.uint64(77))), first)
        flat = pa.array(sig.view(np.int32).reshape(-1))
        offsets = pa.array(np.arange(0, len(flat) + 1, _WIDTH, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(have)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(offsets, flat)],
            names=["id", "h1", "h2", "sig"],
        )


def _root_children(batches: Iterator[pa.RecordBatch], trees: int, branches: int) -> Iterator[pa.RecordBatch]:
    """(id, sig) rows to (id, node, parent, used): the children of every tree's root.

    A root takes the coordinates whose turn it is, so that the first COORDS / branches trees begin with coordinates of
    their own.
    """
    for batch in batches:
        ids, sig = batch.column(0), _matrix(batch.column(1))
        for t in range(trees):
            for slot in range(branches):
                c = (t * branches + slot) % COORDS
                child = mix(mix(np.full(len(sig), t * COORDS + c + 1, np.uint64)) ^ sig[:, c].view(np.uint32))
                used = np.full(len(sig), np.uint64(1) << np.uint64(c), np.uint64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(child.view(np.int64)), pa.nulls(len(sig), pa.int64()), pa.array(used.view(np.int64))], names=["id", "node", "parent", "used"])


def _children(batches: Iterator[pa.RecordBatch], level: int, branches: int) -> Iterator[pa.RecordBatch]:
    """(node, n, used, id, sig) rows to (id, node, parent, used): each document at its node's children.

    `parent` is the node's count, `used` the coordinates of the path as bits. A node takes one coordinate of each part of
    those that its path has not used, by its own hash.
    """
    part = (COORDS - level) // branches
    for batch in batches:
        if not batch.num_rows:
            continue
        node, used = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 2))
        sig = _matrix(batch.column(4))
        free = (used[:, None] >> np.arange(COORDS, dtype=np.uint64)) & np.uint64(1) == 0
        nth = np.cumsum(free, axis=1, dtype=np.int8)
        for slot in range(branches):
            want = slot * part + (mix(node + np.uint64(slot)) % np.uint64(part)).astype(np.int64)
            c = ((nth == want[:, None] + 1) & free).argmax(1)
            child = mix(mix(node ^ mix((c + 1).astype(np.uint64))) ^ sig[np.arange(len(c)), c].view(np.uint32))
            bits = used | (np.uint64(1) << c.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(child.view(np.int64)), batch.column(1), pa.array(bits.view(np.int64))], names=["id", "node", "parent", "used"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches; one byte in 256 agrees by chance."""
    whole = (x[..., :COORDS] == y[..., :COORDS]).sum(-1)
    last = (x[..., COORDS:].view(np.uint8) == y[..., COORDS:].view(np.uint8)).sum(-1)
    return (whole + (last * 256 - BYTES) / 255) / (COORDS + BYTES)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of every vertex of the edges, root the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        m = np.minimum(root[x], root[y])
        new = root.copy()
        for target in (root[x], root[y]):
            np.minimum.at(new, target, m)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        root = new
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return ids, ids[root]


def _links(a: np.ndarray, b: np.ndarray, sim: np.ndarray, sure: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sure): a star for each component of the sure pairs, and the doubtful pairs that none of them joins."""
    if not len(a):
        return
    ok = sim >= sure
    ids, root = stars(a[ok], b[ok])
    a, b = a[~ok], b[~ok]
    if len(ids):
        of = lambda v: np.where(ids[k := np.minimum(np.searchsorted(ids, v), len(ids) - 1)] == v, root[k], v)
        apart = of(a) != of(b)
        a, b = a[apart], b[apart]
    hang = ids != root
    left, right = np.concatenate([root[hang], np.minimum(a, b)]), np.concatenate([ids[hang], np.maximum(a, b)])
    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(np.arange(len(left)) < hang.sum())], names=["a", "b", "sure"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that no value of it stands in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if key[0] != key[-1] or (held and held[-1].column(0)[-1].as_py() != key[0]):  # a run ends in this batch
            end = 0 if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            done = [*held, batch.slice(0, end)]
            held = []
            yield pa.concat_batches(done)
            batch = batch.slice(end)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def compare_nodes(batches: Iterator[pa.RecordBatch], leaf: int, low: float, sure: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, id, sig) sorted by node to links (a, b, sure) of estimated similarity low or more.

    A node of at most `leaf` rows is compared pair by pair. A larger one is searched from one
    document after another: each looks for its partners among those not yet reached, so that a
    node of copies takes one round.
    """

    def pairs(node: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(cut, len(node)))
        rest = np.repeat(size, size) - (np.arange(len(node)) - np.repeat(cut, size))  # rows of the node from here on
        rest[np.repeat(size > leaf, size)] = 0
        live = np.flatnonzero(rest > 1)
        for k in range(1, leaf):
            live = live[rest[live] > k]
            if not len(live):
                break
            for at in np.array_split(live, len(live) // 16384 + 1):
                sim = alike(sig[at], sig[at + k])
                ok = sim >= low
                yield ids[at[ok]], ids[at[ok] + k], sim[ok]
        for c, s in zip(cut[size > leaf], size[size > leaf], strict=True):
            todo = np.arange(c, c + s)
            while len(todo) > 1:
                reach, todo = [todo[0]], todo[1:]
                while reach and len(todo):
                    x = reach.pop()
                    sim = np.concatenate([alike(sig[t], sig[x]) for t in np.array_split(todo, len(todo) // 16384 + 1)])
                    ok = sim >= low
                    yield np.full(ok.sum(), ids[x]), ids[todo[ok]], sim[ok]
                    reach += todo[sim >= sure].tolist()
                    todo = todo[sim < sure]  # a doubtful partner may have a surer one

    for run in _runs(batches):
        node, ids = (run.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        found = list(pairs(node, ids, _matrix(run.column(2))))
        if found:
            yield from _links(*(np.concatenate(x) for x in zip(*found, strict=True)), sure)


def compare_rectangles(batches: Iterator[pa.RecordBatch], low: float, sure: float) -> Iterator[pa.RecordBatch]:
    """Rows (rectangle, id, root, left, sig) sorted by rectangle to links between its left rows and the others of another root."""
    for run in _runs(batches):
        key, ids, root = (run.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        left, sig = run.column(3).to_numpy(zero_copy_only=False), _matrix(run.column(4))
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(key)), strict=True):
            mine, others = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
            found = []
            for x in mine:
                at = others[root[others] != root[x]]
                sim = alike(sig[at], sig[x])
                ok = sim >= low
                found.append((np.full(ok.sum(), ids[x]), ids[at[ok]], sim[ok]))
            if found:
                yield from _links(*(np.concatenate(x) for x in zip(*found, strict=True)), sure)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, u = stars(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        hang = v != u
        yield pa.RecordBatch.from_arrays([pa.array(v[hang]), pa.array(u[hang])], names=["v", "u"])


def _merged(df: DataFrame) -> DataFrame:
    """A join with df is a sort-merge join at every size: a round's small tables do not pile up in the driver as broadcasts."""
    return df.hint("merge")


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, root) of every vertex of edges (a, b), root the smallest id of its component; and the staged paths.

    Each batch of edges becomes stars first; then the large-star and small-star steps alternate until no edge moves.
    """
    spark = edges.sparkSession
    seen, old = None, None
    current = edges.select("a", "b").where("a != b").mapInArrow(_stars, "v long, u long").distinct()
    while True:
        watch = Observation()
        current = current.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 24))).alias("s"))
        current, path = stage(current, "edges")
        now = (watch.get["n"], watch.get["s"])
        if old:
            release(spark, old)
        old = path
        if now == seen:
            break
        seen = now
        both = current.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u")
        mins = _merged(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = both.where("u > v").join(mins, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small_min = _merged(large.groupBy("v").agg(F.min("u").alias("m")))
        # every smaller neighbour, and v itself, hangs on the smallest
        hung = large.join(small_min, "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("v"), F.col("e.m").alias("u"))
        current = hung.where("u != v").distinct()
    roots = current.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct()), [path]


def _sets(docs: DataFrame, ids: DataFrame, shingle: int, most: int) -> DataFrame:
    """(id, sorted distinct shingle hashes) of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t__"):
            scan = Scan(batch.column(1))
            h, doc = doc_shingles(scan, shingle)
            cut = np.searchsorted(doc, np.arange(scan.n_docs + 1))
            out = [np.unique(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "hs"])

    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(run, "id long, hs binary")


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both / max(1, len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])


def _search(spark, reps: DataFrame, trees: int, branches: int, leaf: int, block: int, low: float, sure: float) -> tuple[DataFrame, list[str]]:
    """Links (a, b, sure) among the sketched rows (id, sig), and the staged paths."""
    links, paths, lists = "a long, b long, sure boolean", [], []
    entries, pool, branching = reps.select("id", "sig").mapInArrow(lambda it: _root_children(it, trees, branches), "id long, node long, parent long, used long"), reps.select("id", "sig"), None
    for level in range(LEVELS):
        counts = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.max("used").alias("used")).where("n > 1")
        final = F.lit(level == LEVELS - 1) | (F.col("n") <= leaf) | F.coalesce(F.col("n") * 10 > F.col("parent") * 7, F.lit(False))
        watch = Observation()
        live = entries.select("node", "id").join(_merged(counts.select("node", "n", "used", final.alias("final"))), "node")
        live = live.observe(watch, F.count_if(~F.col("final")).alias("more"), F.count_if(F.col("final") & (F.col("n") > leaf)).alias("large"), F.max("n").alias("most"))
        live, p = stage(live, "nodes")
        lists.append((live, watch.get["large"], watch.get["most"]))
        paths.append(p)
        if not watch.get["more"]:
            break
        before = branching
        rows, branching = stage(live.where("NOT final").join(_merged(pool), "id").select("node", "n", "used", "id", "sig"), "branching")
        if before:
            release(spark, before)
        entries = rows.mapInArrow(lambda it, k=level + 1: _children(it, k, branches), "id long, node long, parent long, used long")
        pool = rows.select("id", "sig").dropDuplicates(["id"])  # the next level needs no other sketches
    if branching:
        release(spark, branching)
    done = lists[0][0].where("final")
    for more, _, _ in lists[1:]:
        done = done.union(more.where("final"))
    # a large node is so many blocks; a small one is compared whole
    blocks = F.when(F.col("n") > leaf, F.ceil(F.col("n") / block)).otherwise(F.lit(1)).cast("long")
    at = F.pmod(F.xxhash64("id"), F.col("blocks"))
    done = done.select("node", "id", "n", blocks.alias("blocks"))
    keyed = done.select(F.when(F.col("blocks") > 1, F.xxhash64("node", at)).otherwise(F.col("node")).alias("key"), "id").join(_merged(reps.select("id", "sig")), "id").select("key", "id", "sig")
    found, p = stage(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda it: compare_nodes(it, leaf, low, sure), links), "links")
    paths.append(p)
    if not any(large and most > block for _, large, most in lists):
        return found, paths
    # nodes of several blocks: what is outside the largest component meets every block
    roots, p = components(found.where("sure"))
    paths += p
    wide = done.where("blocks > 1").join(_merged(roots), "id", "left").select("node", "id", "blocks", F.coalesce("root", "id").alias("root"))
    wide, p = stage(wide, "wide")
    paths.append(p)
    most = wide.groupBy("node", "root").agg(F.count(F.lit(1)).alias("k"), F.first("blocks").alias("blocks")).groupBy("node").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("minor")).where("minor > 0")
    rows = wide.join(_merged(most), "node").withColumn("lefts", F.ceil(F.col("minor") / (4 * block)).cast("long")).withColumn("h", F.xxhash64("id", F.lit(1)))
    to = lambda left: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks" if left else "lefts") - 1), lambda k: F.struct(
        F.xxhash64("node", *((F.pmod("h", "lefts"), k) if left else (k, F.pmod(F.xxhash64("id"), F.col("blocks"))))).alias("key"), F.lit(left).alias("left")))
    sent = rows.withColumn("to", F.explode(F.concat(to(False), F.when(F.col("root") != F.col("main"), to(True)).otherwise(F.array().cast("array<struct<key:bigint,left:boolean>>")))))
    sent = sent.select("to.key", "id", "root", "to.left").join(_merged(reps.select("id", "sig")), "id").select("key", "id", "root", "left", "sig")
    across, p = stage(sent.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda it: compare_rectangles(it, low, sure), links), "across")
    paths.append(p)
    return found.union(across), paths


def near_groups(
    docs: DataFrame, *, threshold: float = 0.5, shingle: int = 3, branches: int = 3, recall: float = 0.99, leaf: int = 128, block: int = 4096, id_col: str = "doc_id", text: str = "text",
    max_broadcast_ids: int = MAX_BROADCAST_IDS,
) -> DataFrame:
    """(doc_id, group_id, n_links) of every document in a group of two or more.

    group_id is the group's smallest doc_id, n_links the number of other documents that links, direct or through others, join it to.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t__")).where("id IS NOT NULL AND t__ IS NOT NULL")
    sketched, p_sketch = stage(narrow.mapInArrow(lambda it: sketches(it, shingle), "id long, h1 long, h2 long, sig array<int>"), "sketch")
    if not sketched.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sketched = sketched.groupBy("id").agg(F.min_by(F.struct("h1", "h2", "sig"), F.struct("h1", "h2")).alias("s")).select("id", "s.h1", "s.h2", "s.sig")
    # the first of each set of copies stands for all; the sets are never gathered
    reps, p_reps = stage(sketched.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig")), "reps")
    firsts = reps.select("h1", "h2", F.col("id").alias("rep"))
    copies, p_copies = stage(sketched.select("id", "h1", "h2").join(_merged(firsts), ["h1", "h2"]).where("id != rep").select("id", "rep"), "copies")
    release(spark, p_sketch)

    margin = 3 * (threshold * (1 - threshold) / (COORDS + BYTES)) ** 0.5
    low, sure = threshold - margin, threshold + margin
    pairs, paths = _search(spark, reps, trees_for(threshold, branches, recall), branches, leaf, block, low, sure)
    roots, p_roots = components(pairs.where("sure"))
    doubtful = pairs.where("NOT sure").select("a", "b").distinct()
    ra, rb = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    doubtful = doubtful.join(_merged(ra), "a", "left").join(_merged(rb), "b", "left").where("ra IS NULL OR rb IS NULL OR ra != rb").select("a", "b")
    doubtful, p_doubt = stage(doubtful, "doubtful")
    ids = doubtful.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets, p_sets = stage(_sets(narrow, ids, shingle, max_broadcast_ids).groupBy("id").agg(F.min("hs").alias("hs")), "sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("hs").alias("x")), sets.select(F.col("id").alias("b"), F.col("hs").alias("y"))
    exact = doubtful.join(_merged(x), "a").join(_merged(y), "b").select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)
    edges = roots.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")).union(exact.select("a", "b")).union(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    groups, _ = components(edges)
    release(spark, p_reps, p_copies, p_doubt, p_sets, *paths, *p_roots)
    sizes = groups.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return groups.join(_merged(sizes), "root").select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, the one of the smallest doc_id; rows with a null id stay.

    A repeated id leaves one row, that of its smallest text.
    """
    id_col, text = options.get("id_col", "doc_id"), options.get("text", "text")
    drop_c, twice_c, rank_c = (spare(docs.columns, x) for x in ("drop__", "twice__", "rank__"))
    drop = near_groups(docs, **options).where("doc_id != group_id").select(F.col("doc_id").alias(drop_c))
    kept = docs.join(_merged(drop), docs[id_col].cast("long") == drop[drop_c], "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(twice_c)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(twice_c)
    if twice.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text).asc_nulls_last()))
    again = kept.join(twice, kept[id_col] == twice[twice_c], "left_semi").withColumn(rank_c, first).where(F.col(rank_c) == 1).drop(rank_c)
    return kept.join(twice, kept[id_col] == twice[twice_c], "left_anti").unionByName(again)


def op10_minhash_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Groups of near copies (Jaccard of 3-word shingles of 0.5 or more) over all documents."""
    from corvane.llm.common import table

    return near_groups(table(spark, sf_dir, "documents"))
