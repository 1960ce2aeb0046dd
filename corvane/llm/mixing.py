"""Mixing sources to target weights: a time-varying curriculum.

Training runs over time 0..1. At each knot of the schedule every source has a
weight; shares are the weights divided by their sum over the sources at hand, and
run straight between knots (they sum to 1 at all times). A source's cumulative
demand at time t is the integral of its share up to t, times the token budget.
Its documents are laid end to end in a pseudo-random order, once per epoch, and a
document whose middle token is the c-th of its source trains at the time when the
demand reaches c: the inverse of a piecewise quadratic. Documents whose middle
lies beyond the demand at time 1 are not trained on; a source whose demand exceeds
its tokens starts over (epoch 1, 2, ...). The result is sorted by position across
range partitions.

The budget is by default the tokens there are, so that a source at its natural
share is read once.

Defined cases: tokens are runs of non-space characters; null and empty texts have
none and are never placed. A null source is a source of its own. A source without
a schedule entry takes the weights of "*"; if there is none, it is left out, as is
one whose weights are all 0. Repeated rows are laid out
one after another, each with its own place. Ties of the pseudo-random order go by
doc_id. Extra columns pass through. Empty tables give an empty result.

Very long texts count like others; rows of a null id share one hash, so they
are one bucket of their source.

Scale: no window runs over a source. Tokens are counted once, in a staged table. Each source is cut into buckets by a hash, a
small table of buckets (sources x 4096 at most) is summed up, and the running sum
of a bucket starts at its offset, joined on the partitioning that the window has already; so a hot source is 4096 tasks' work, not one's.
Texts move twice: to their bucket and to their range. One row for each source comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import spare, stage, table

#: (time, {source: weight}); "*" stands for every other source.
Schedule = list[tuple[float, dict[str, float]]]


def shares(schedule: Schedule, sources: list[str | None]) -> list[tuple[str | None, float, float, float, float, float]]:
    """(source, t0, t1, share at t0, share at t1, integral up to t0) of every segment."""
    rows = []
    knots = sorted(schedule, key=lambda k: k[0])
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to time 1")
    at = []
    for _, weights in knots:
        w = [max(0.0, float(weights.get(s if s is not None else "", weights.get("*", 0.0)))) for s in sources]
        total = sum(w)
        at.append([x / total if total else 0.0 for x in w])
    for i, s in enumerate(sources):
        done = 0.0
        for k in range(len(knots) - 1):
            t0, t1 = knots[k][0], knots[k + 1][0]
            a, b = at[k][i], at[k + 1][i]
            rows.append((s, t0, t1, a, b, done))
            done += (a + b) / 2 * (t1 - t0)
    return rows


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, schedule: Schedule, *, budget: int | None = None, text: str = "text", source: str = "source", id_col: str = "doc_id", bucket_digits: int = 3,
    with_text: bool = True,
) -> DataFrame:
    """docs with epoch, position (0..1) and n_tokens, sorted by position; without text if with_text is false."""
    spark = docs.sparkSession
    cols = docs.columns if with_text else [c for c in docs.columns if c != text]
    n, epoch, position = (spare(docs.columns, x) for x in ("n_tokens", "epoch", "position"))
    # working columns, under names that no column of docs has
    h, b, src, run, mid, want, seg = (spare(docs.columns, f"mix_{x}__") for x in ("hash", "bucket", "source", "run", "mid", "want", "seg"))
    s_, b_, before, z_, supply_, segs, demand = (spare(docs.columns, f"mix_{x}__") for x in ("s", "b", "before", "z", "supply", "segs", "demand"))
    # a null source is a key like any other
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    prepared, _ = stage(
        docs.withColumn(n, token_count(text)).where(F.col(n) > 0)
        .withColumn(h, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).withColumn(b, F.substring(h, 1, bucket_digits)).withColumn(src, key)
        .select(*cols, n, h, b, src), "counted",
    )
    sums, _ = stage(prepared.groupBy(F.col(src).alias(s_), F.col(b).alias(b_)).agg(F.sum(n).alias("tokens")), "mixing")
    # sources are few (a domain list); their number, not the documents', is what comes to the driver
    supply = {r[0][1:] if r[0] else None: r[1] for r in sums.groupBy(s_).agg(F.sum("tokens").alias("tokens")).collect()}
    total = budget if budget is not None else sum(supply.values())
    by_source = shares(schedule, sorted(supply, key=lambda s: (s is not None, s or "")))
    parts: dict[str | None, list[tuple]] = {}
    for s, *segment in by_source:
        parts.setdefault(s, []).append(tuple(segment))
    rows = [("" if s is None else "=" + s, supply[s], p, total * sum((x[2] + x[3]) / 2 * (x[1] - x[0]) for x in p)) for s, p in parts.items()]
    per_source = spark.createDataFrame(rows, f"{z_} string, {supply_} long, {segs} array<struct<t0:double,t1:double,p:double,q:double,done:double>>, {demand} double")
    offsets = sums.withColumn(before, F.sum("tokens").over(Window.partitionBy(s_).orderBy(b_)) - F.col("tokens")).drop("tokens")
    order = Window.partitionBy(src, b).orderBy(h, id_col)
    laid = prepared.withColumn(run, F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the window's partitioning is the join's: only the small side moves
    placed = laid.join(offsets.hint("merge"), (F.col(src) == F.col(s_)) & (F.col(b) == F.col(b_)))
    placed = placed.join(F.broadcast(per_source) if len(rows) <= 10_000 else per_source, F.col(src) == F.col(z_))
    placed = placed.withColumn(mid, F.col(before) + F.col(run) - F.col(n) / 2).where((F.col(demand) > 0) & (F.col(mid) < F.col(demand)))
    last_epoch = F.ceil((F.col(demand) - F.col(mid)) / F.col(supply_)).cast("int") - 1
    epochs = placed.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), last_epoch))))
    found = epochs.withColumn(want, (F.col(mid) + F.col(epoch) * F.col(supply_)) / F.lit(float(max(total, 1))))

    def invert(x: Column) -> Column:
        """The time within segment x at which the integral reaches what is wanted."""
        span, rest = x["t1"] - x["t0"], F.greatest(F.lit(0.0), F.col(want) - x["done"])
        slope = (x["q"] - x["p"]) / span
        root = F.sqrt(F.greatest(F.lit(0.0), x["p"] * x["p"] + 2 * slope * rest))
        # 2 c / (b + sqrt(b^2 + 2 a c)) holds for a flat share too
        return x["t0"] + F.least(span, F.when(x["p"] + root > 0, 2 * rest / (x["p"] + root)).otherwise(F.lit(0.0)))

    segment = F.element_at(F.filter(segs, lambda x: (x["done"] <= F.col(want)) & ((x["p"] > 0) | (x["q"] > 0))), -1)
    out = found.withColumn(seg, segment).withColumn(position, F.round(invert(F.col(seg)), 9))
    return out.select(*cols, n, epoch, position).repartitionByRange(F.col(position), F.col(epoch), F.col(id_col)).sortWithinPartitions(position, epoch, id_col)


#: Production schedule: the one large source at two fifths of the tokens at first and a fifth at the end, the others level.
SCHEDULE: Schedule = [(0.0, {"src0": 12.0, "*": 1.0}), (0.6, {"src0": 8.0, "*": 1.0}), (1.0, {"src0": 5.0, "*": 1.0})]


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """The training order of the whole documents table: position and epoch of every document placed."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs.select("doc_id", "text", "source"), SCHEDULE, with_text=False)


#: The same in DuckDB: one window over each source, the segment by a join.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens / 2.0 AS mid FROM d WHERE n_tokens > 0),
total AS (SELECT sum(n_tokens)::DOUBLE AS total FROM e),
supply AS (SELECT source, sum(n_tokens) AS supply FROM e GROUP BY source),
knots(k, t, hot) AS (VALUES (0, 0.0::DOUBLE, 12.0::DOUBLE), (1, 0.6::DOUBLE, 8.0::DOUBLE), (2, 1.0::DOUBLE, 5.0::DOUBLE)),
w AS (SELECT source, supply, k, t, CASE WHEN source = 'src0' THEN hot ELSE 1.0 END AS w FROM supply, knots),
p AS (SELECT source, supply, k, t, w / sum(w) OVER (PARTITION BY k) AS p FROM w),
seg AS (SELECT a.source, a.supply, a.k, a.t AS t0, b.t AS t1, a.p, b.p AS q FROM p a JOIN p b ON a.source IS NOT DISTINCT FROM b.source AND b.k = a.k + 1),
s2 AS (SELECT *, coalesce(sum((p + q) / 2 * (t1 - t0)) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM seg),
demand AS (SELECT source, any_value(supply) AS supply, sum((p + q) / 2 * (t1 - t0)) * any_value(total) AS demand, any_value(total) AS total FROM s2, total GROUP BY source),
copies AS (
  SELECT e.doc_id, e.source, e.n_tokens, unnest(range(0, greatest(1, ceil((demand - mid) / supply)::BIGINT)))::INT AS epoch, mid, supply, total
  FROM e JOIN demand ON e.source IS NOT DISTINCT FROM demand.source WHERE mid < demand),
want AS (SELECT *, (mid + epoch * supply) / total AS want FROM copies),
found AS (
  SELECT want.*, s2.t0, s2.t1, s2.p, s2.q, s2.done, row_number() OVER (PARTITION BY doc_id, want.epoch, mid ORDER BY s2.k DESC) AS r
  FROM want JOIN s2 ON want.source IS NOT DISTINCT FROM s2.source AND s2.done <= want)
SELECT doc_id, source, n_tokens, epoch,
  round(t0 + least(t1 - t0, 2 * (want - done) / (p + sqrt(greatest(0, p * p + 2 * (q - p) / (t1 - t0) * (want - done))))), 9) AS position
FROM found WHERE r = 1
"""
