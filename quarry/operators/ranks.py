"""Places and running sums within groups of any size: groups are cut into ranges of the order first, so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range of all groups together holds, about, and ranges at most (a group has a part in each).
RANGE_ROWS, MAX_RANGES = 500_000, 4096


def range_of(df: DataFrame, order: str, rows: int | None = None) -> Column:
    """How many of the order's approximate quantiles lie below a row's value: a number that never falls as the order rises. order: a numeric column."""
    n = rows if rows is not None else df.count()
    ranges = int(min(max(n // RANGE_ROWS, 8), MAX_RANGES))
    bounds = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges).alias("b")).first().b or []
    # Bounds by the thousand in one literal, found by halving.
    bounds = sorted(set(bounds))
    steps = max(1, len(bounds).bit_length())
    kind = df.schema[order].dataType
    literal = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    halves = F.array(*[F.lit(1 << (steps - 1 - k)) for k in range(steps)])
    here = F.col(order)
    at = F.aggregate(halves, F.lit(0), lambda a, half: F.when((a + half <= len(bounds)) & (F.get(literal, a + half - 1) < here), a + half).otherwise(a))
    return F.when(here.isNull(), F.lit(-1)).otherwise(at)


def with_places(df: DataFrame, by: str | None, order: list[str], ranges: Column, weight: Column | None = None) -> DataFrame:
    """df with place (from 0) of each row in its group by `order`, and before, the sum of `weight` of those ahead; by None: all rows are one group.

    ranges: a number that never falls as the order rises. Each part of a group (its rows of one range) is counted and summed in a first pass; what lies ahead of
    a part comes from these sums, which are as many as groups times ranges; rows are ordered within their part alone. A null group is one too.
    """
    w = F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(0)
    group = F.struct(F.col(by)) if by else F.lit(0)
    parted = df.withColumn("_g", group).withColumn("_r", ranges).withColumn("_w", w.cast("long"))
    sums = parted.groupBy("_g", "_r").agg(F.count("*").alias("n"), F.sum("_w").alias("s"))
    whole = sums.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_r", "n", "s"))).alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"), F.array().cast("array<struct<r:int,n:bigint,s:bigint>>").alias("seen"))
    run = F.aggregate(
        "parts", start,
        lambda a, p: F.struct((a["n"] + p["n"]).alias("n"), (a["s"] + p["s"]).alias("s"), F.concat(a["seen"], F.array(F.struct(p["_r"].cast("int").alias("r"), a["n"].alias("n"), a["s"].alias("s")))).alias("seen")),
    )
    ahead = whole.select("_g", F.inline(run["seen"])).select(F.col("_g").alias("_ag"), F.col("r").alias("_ar"), F.col("n").alias("_n"), F.col("s").alias("_s"))
    joined = parted.join(ahead, (F.col("_g") == F.col("_ag")) & (F.col("_r") == F.col("_ar")))
    part = Window.partitionBy("_g", "_r").orderBy(*order)
    placed = joined.withColumn("place", F.col("_n") + F.row_number().over(part) - 1).withColumn("before", F.col("_s") + F.sum("_w").over(part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
    return placed.drop("_g", "_r", "_w", "_ag", "_ar", "_n", "_s")
