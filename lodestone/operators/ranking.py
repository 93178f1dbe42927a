"""Ranking, first-seen duplicates, cache joins and interval merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered 1 to n in a total order, without bringing them into one partition.

    Rows are dealt by ranges of the order, sorted and written with their places; numbers within a range are added to the sizes of
    the ranges before it, which is one number per partition. Ranges are drawn from a sample, which differs from one exchange to
    the next, so places and sizes have to be read from the same table.
    """
    at, part = (next(c for c in (x, x + "_", x + "__") if c not in df.columns) for x in ("at_", "part_"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out once before, so that what is costly in ``df`` isn't computed again for sampling
    dealt = df.repartition(n).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of the partition above 33 bits, the place in it below
    placed = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(at, 33))
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = placed.groupBy(part).agg(F.max(place).alias("size"))
    before = sizes.select(part, F.coalesce(F.sum("size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), part).withColumn(name, place + F.col("before")).drop(at, part, "before")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order, numbered: a bounded sort in each partition."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_of_each(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def first_seen(df: DataFrame, content: str, position: str, shown: str, among: DataFrame | None = None) -> DataFrame:
    """``duplicate_of``: for each row but the first with its content what the first one shows; null or empty content is no duplicate.

    Firsts come from a partial aggregate, so a content that many rows share is no burden to one task. ``among``: a table that has
    the same rows without what ``df`` joined to them, so that it isn't worked out again.
    """
    firsts = (df if among is None else among).where(F.col(content) != "").groupBy(F.col(content).alias("content_")).agg(F.min(F.struct(position, shown)).alias("first_"))
    out = df.join(firsts, F.col(content) == F.col("content_"), "left")
    later = F.col(position) > F.col(f"first_.{position}")
    return out.withColumn("duplicate_of", F.when(later, F.col(f"first_.{shown}"))).drop("content_", "first_")


def cache_hits(docs: DataFrame, cache: DataFrame, key: str = "sha1", text: str = "text") -> DataFrame:
    """Documents whose content is in the cache with a text that isn't empty."""
    return docs.join(cache.where(F.coalesce(text, F.lit("")) != ""), key)


def cache_misses(docs: DataFrame, cache: DataFrame, key: str = "sha1", text: str = "text") -> DataFrame:
    return docs.join(cache.where(F.coalesce(text, F.lit("")) != "").select(key), key, "left_anti")


def merged_spans(spans: DataFrame, key: str, a: str = "a", b: str = "b", gap: int = 1) -> DataFrame:
    """(key, a, b) of the unions of spans, where a span that starts at most ``gap`` behind another's end joins it."""
    order = Window.partitionBy(key).orderBy(a, b)
    far = F.max(b).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(far.isNull() | (F.col(a) > far + gap), 1).otherwise(0)
    island = F.sum("opens_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.withColumn("opens_", opens).withColumn("island_", island).groupBy(key, "island_").agg(F.min(a).alias(a), F.max(b).alias(b)).drop("island_")
