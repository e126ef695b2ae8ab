"""Turn lengths, summaries and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a group that are worked on together; groups of any length spread over many tasks.
CHUNK = 4096


def _same(cols: list[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return on


def _of(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_of_{c}") if c in cols else F.col(c) for c in df.columns])


def _chunked(df: DataFrame, position: str) -> DataFrame:
    return df.withColumn("_k", F.coalesce(F.floor(F.col(position) / CHUNK).cast("long"), F.lit(-(1 << 62)).cast("long")))


def turn_runs(rows: DataFrame, group: str, speaker: str, words: Column, order: list[str]) -> DataFrame:
    """(group, run, speaker, n_words): neighbours of one speaker merged, wordless rows left out before comparing.

    ``order`` starts with a number (null first). A group is cut into chunks of ``CHUNK`` positions;
    what crosses their borders is settled on one row per chunk.
    """
    key = [group, "_k"]
    spoken = _chunked(rows.withColumn("_n", words).filter("_n > 0").select(group, *dict.fromkeys([speaker, *order]), "_n"), order[0])
    lasts = spoken.groupBy(*key).agg(F.max_by(F.struct(F.col(speaker).alias("s")), F.struct(*order)).alias("_last"))
    chunks = Window.partitionBy(group).orderBy("_k")
    lasts = lasts.withColumn("_prev", F.lag("_last").over(chunks)).drop("_last")
    inside = Window.partitionBy(*key).orderBy(*order)
    before = F.coalesce(F.lag(F.struct(F.col(speaker).alias("s"))).over(inside), F.col("_prev"))
    marked = spoken.join(_of(lasts, key), _same(key)).withColumn("_before", before)
    changed = F.when(F.col("_before").isNotNull() & F.col("_before.s").eqNullSafe(F.col(speaker)), 0).otherwise(1)
    marked = marked.withColumn("_c", changed).withColumn("_in", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(*key, "_in").agg(F.first(F.struct(F.col(speaker).alias("s"))).alias("s"), F.sum("_n").alias("n"))
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy(*key).agg(F.max("_in").alias("m")).withColumn("_runs", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    runs = pieces.join(_of(starts, key), _same(key)).withColumn("run", F.col("_runs") + F.col("_in"))
    return runs.groupBy(group, "run").agg(F.first("s").alias("s"), F.sum("n").cast("long").alias("n_words")).select(group, "run", F.col("s.s").alias(speaker), "n_words")


def summary(df: DataFrame, col: str) -> DataFrame:
    """Number, mean, population deviation, least and most; one row, all but the number null when empty."""
    return df.agg(
        F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_pop(col), 6).alias("std"),
        F.min(col).alias("least"), F.max(col).alias("most"),
    )


def histograms(populations: dict[str, DataFrame], most: int = 40) -> DataFrame:
    """Exact-value histograms of several single-column populations on their common, zero-filled values.

    A tagged union and one aggregation: values up to ``most``, a column of counts for each population.
    """
    tagged = [d.toDF("value").select(F.col("value").cast("long"), F.lit(name).alias("tag")) for name, d in populations.items()]
    every = reduce(DataFrame.unionByName, tagged).filter(F.col("value") <= most)
    return every.groupBy("value").agg(*[F.count(F.when(F.col("tag") == name, 1)).alias(f"n_{name}") for name in populations])


def running(df: DataFrame, group: list[str], position: str, col: str, every: int) -> DataFrame:
    """Running mean and population deviation at every ``every``-th row, by ``position``, and at the end of each group.

    ``position`` is a number and unique in its group, ``col`` a whole number. Sums of whole chunks go before the sums inside a chunk.
    """
    key = [*group, "_k"]
    rows = _chunked(df.withColumn("_x", F.col(col).cast("double")), position)
    inside = Window.partitionBy(*key).orderBy(position)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    chunks = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    earlier = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(*key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in "nsq"], F.sum("n").over(Window.partitionBy(*group)).alias("_all"))
    out = rows.withColumn("i", F.row_number().over(inside)).withColumn("s", F.sum("_x").over(so_far)).withColumn("q", F.sum(F.col("_x") * F.col("_x")).over(so_far))
    out = out.join(_of(before, key), _same(key)).withColumn("i", F.col("i") + F.col("_n")).filter((F.col("i") % every == 0) | (F.col("i") == F.col("_all")))
    mean = (F.col("s") + F.col("_s")) / F.col("i")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") + F.col("_q")) / F.col("i") - mean * mean))
    return out.select(*df.columns, "i", F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("std"))


def share_left(df: DataFrame, seconds: str, used: Column) -> Column:
    """Percentage of the seconds that is not used; 0 of nothing."""
    total = F.sum(seconds)
    return F.coalesce(100 * F.sum(F.when(used, F.lit(0.0)).otherwise(F.col(seconds))) / F.when(total != 0, total), F.lit(0.0))
