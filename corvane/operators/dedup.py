"""Keep-first, per-group caps, diversity and token budgets over ranked results (WIN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: str | list[str], *order: Column | str) -> DataFrame:
    """WIN-1: the first row of each group."""
    return keep_n(df, by, 1, *order)


def keep_n(df: DataFrame, by: str | list[str], n: int, *order: Column | str) -> DataFrame:
    """WIN-2, WIN-4: at most n rows of each group. Spark turns it into a limit per group before the shuffle."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("nth__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth__") <= n).drop("nth__")


def diversify(df: DataFrame, book: str, *order: Column | str, share: float = 0.5, most: int = 3) -> DataFrame:
    """WIN-3, AGG-10: at most `most` rows of a book if one book has more than `share` of all rows; otherwise all rows."""
    counts = df.groupBy(F.col(book).alias("b__")).agg(F.count(F.lit(1)).alias("n__"))
    top = counts.agg((F.max("n__") / F.sum("n__")).alias("share__"))  # a single row
    w = Window.partitionBy(book).orderBy(*order)
    return (
        df.withColumn("nth__", F.row_number().over(w)).crossJoin(F.broadcast(top))
        .where((F.col("share__") <= share) | (F.col("nth__") <= most)).drop("nth__", "share__")
    )


def parent_order(df: DataFrame, parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """WIN-5: (parent, place): parents in the order of their best child."""
    first = df.groupBy(parent).agg(F.min(rank).alias("first__"))
    return first.select(parent, (F.row_number().over(Window.orderBy("first__", parent)) - 1).alias("place"))


def budgets(n: Column | int, *, total: int = 12000, first: int = 4000, second: int = 2000, least: int = 400) -> Column:
    """WIN-6: tokens granted to each of n parents in turn: up to `first`, up to `second`, then an equal share of the rest.

    A fold over 0..n-1 that carries what remains; every grant is also capped by what remains and by `first`.
    """
    count = n if isinstance(n, Column) else F.lit(n)
    start = F.struct(F.lit(total).alias("rem"), F.array().cast("array<int>").alias("out"))

    def grant(acc: Column, k: Column) -> Column:
        share = F.greatest(F.lit(least), F.floor(acc["rem"] / F.greatest(F.lit(1), count - k)).cast("int"))
        want = F.when(k == 0, F.lit(first)).when(k == 1, F.lit(second)).otherwise(share)
        given = F.greatest(F.lit(0), F.least(want, F.lit(first), acc["rem"])).cast("int")
        return F.struct((acc["rem"] - given).cast("int").alias("rem"), F.concat(acc["out"], F.array(given)).alias("out"))

    steps = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, grant)["out"]


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """WIN-10: the last n rows of each group."""
    return keep_n(df, by, n, F.desc(order))


def compress_history(turns: DataFrame, *, recent: int = 8, cut: int = 200) -> DataFrame:
    """WIN-9: each conversation's last `recent` turns whole, the earlier ones cut to `cut` characters."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back__", back).withColumn("text", F.when((F.col("back__") > recent) & (F.length("text") > cut), F.concat(F.substring("text", 1, cut), F.lit("..."))).otherwise(F.col("text"))).drop("back__")


def forward_fill(df: DataFrame, by: str, order: str, col: str, out: str) -> DataFrame:
    """WIN-7: the last value that is not null, so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w))


def segment_ends(df: DataFrame, by: str, order: str, total: str, out: str) -> DataFrame:
    """WIN-8: where the next segment begins, or the total."""
    return df.withColumn(out, F.coalesce(F.lead(order).over(Window.partitionBy(by).orderBy(order)), F.col(total)))
