"""Ranks and running sums within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.runtime import Workspace


def hashed_rank(
    df: DataFrame, keys: list[str], order: Column, tie: list[str], rows: int, weight: str | None = None, bucket_rows: int = 100_000
) -> DataFrame:
    """Add ``rank`` (1-based, by ``order`` then ``tie``) and, with ``weight``, ``before``: the weight of all lower ranks.

    ``order`` must be a uniform 64-bit hash. Its range is cut into so many buckets that a bucket
    holds about ``bucket_rows`` rows even if all ``rows`` share one key, so a hot group is spread
    over as many tasks as it needs; bucket totals (one row per key and bucket) give the offsets.
    Null keys form a group of their own.
    """
    buckets = min(1 << 20, max(1, -(-rows // bucket_rows)))
    top = F.shiftright("_h", 44) + F.lit(1 << 19)  # 0 .. 2^20 - 1, in the order of the hash
    cut = F.shiftright(top * F.lit(buckets), 20).cast("long")
    out = df.withColumn("_h", order)
    out = out.withColumn("_b", cut if buckets > 1 else F.lit(0).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *tie)
    w = F.col(weight) if weight else F.lit(0)
    out = out.withColumn("rank", F.row_number().over(inside).cast("long"))
    if weight:
        out = out.withColumn("before", F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.withColumn("before", F.coalesce("before", F.lit(0).cast(out.schema[weight].dataType)))
    if buckets > 1:
        totals = df.withColumn("_h", order).withColumn("_b", cut).groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_b").alias("_k_b"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
        )
        on = F.col("_b") == F.col("_k_b")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(offsets, on).withColumn("rank", F.col("rank") + F.col("_n0"))
        if weight:
            out = out.withColumn("before", F.col("before") + F.col("_w0"))
        out = out.drop(*[f"_k_{k}" for k in keys], "_k_b", "_n0", "_w0")
    return out.drop("_h", "_b")


def sorted_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank`` (0-based) in the order of ``by`` over all rows: ranges of the order are numbered side by side.

    The ranges are stored once, since their borders are sampled; only their sizes are summed up in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = Workspace(spark, "ranks").save(df.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()), "laid")
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*by))
    return laid.withColumn("rank", inside - 1).join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn("rank", F.col("rank") + F.col("_o")).drop("_p", "_q", "_o")
