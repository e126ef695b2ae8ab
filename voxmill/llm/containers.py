"""Filling fixed-capacity containers (problem 7): vector bin packing by the dot-product heuristic.

An item has tokens, one segment and loss-bearing tokens; a container limits all three at once, so
that no batch is all short pieces or all targets. Only items above the token capacity are cut; one
within it that alone bears more loss than the limit is the only loss-bearing item of its container.
Items are dealt to shards by hash; each shard fills one container after the other, always with the
fitting item whose demand has the largest weighted dot product with the room that is left. The
containers that a round leaves less than ``FULL`` full are emptied and packed again together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.tokens import with_tokens
from voxmill.runtime import Workspace

#: Containers and items that a shard holds about and at most; rounds; and the share from which one counts as full.
SHARD_CONTAINERS, SHARD_ITEMS, ROUNDS, FULL = 64, 16_384, 3, 0.995
#: A container may hold a segment per so many tokens of capacity, and at least so many; and the share of its
#: capacity that may bear loss.
TOKENS_PER_SEGMENT, LEAST_SEGMENTS, LOSS_SHARE = 128, 8, 0.95
#: How far an item's size is taken out of its score, and the part of the tokens' room from which on it is not.
NORM, CLOSE = 0.85, 0.05
#: Most kinds of container.
MAX_KINDS = 1000

KIND = ["container", "capacity", "most_segments", "most_loss"]
ITEM = ["doc_id", "piece", "n_pieces", "unnamed", "tokens", "loss_tokens"]
PACKED = "container string, capacity long, most_segments long, most_loss long, doc_id long, piece int, n_pieces int, unnamed boolean, tokens long, loss_tokens long, bin string"


def pack(demand: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Container number of each item; ``demand`` (items x dimensions) fits ``limit`` item by item.

    The next item is the fitting one with the largest dot product of its demand and the room left,
    where room is what a container would have that fills up in the proportions of all items left:
    otherwise long items would go first and leave containers full of segments but not of tokens.
    The product is divided by the item's norm to the power ``NORM``, so that the direction counts
    more than the size, until ``CLOSE`` of the tokens' room is left, which the largest fitting item
    closes. Equal items are one kind with a count, so a step costs the number of kinds. Ties go to
    the kind with the larger demand, first dimension first.
    """
    kinds, of, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    share = kinds / limit
    size = np.maximum((share**2).sum(axis=1), 1e-30) ** (NORM / 2)
    members = np.argsort(of, kind="stable")
    at = np.r_[0, np.cumsum(count)][:-1].copy()
    ends = at + count
    columns, shares = [c.astype(float) for c in kinds.T], [np.ascontiguousarray(c) for c in share.T]
    out = np.full(len(demand), -1)
    left, number, rest = len(demand), 0, (share * count[:, None]).sum(axis=0)
    live = np.ones(len(kinds), bool)
    while left:
        room = limit.astype(float)
        spare = 1 - np.maximum(rest, 0) / max(rest.max(), 1e-30)
        while True:
            fits = live & (columns[0] <= room[0])
            for c, r in zip(columns[1:], room[1:]):
                fits &= c <= r
            some = fits.nonzero()[0]
            if not len(some):
                break
            weight = np.maximum(room / limit - spare, 1e-6)
            score = shares[0][some] * weight[0]
            for c, w in zip(shares[1:], weight[1:]):
                score += c[some] * w
            if room[0] > CLOSE * limit[0]:
                score /= size[some]
            k = some[len(score) - 1 - score[::-1].argmax()]
            out[members[at[k]]] = number
            at[k] += 1
            live[k] = at[k] < ends[k]
            left -= 1
            room -= kinds[k]
            rest -= share[k]
        number += 1
    return out


def limits(capacity: Column, tokens_per_segment: int, loss_share: float) -> tuple[Column, Column]:
    """Most segments, and most loss-bearing tokens, of a container."""
    segments = F.greatest(F.lit(LEAST_SEGMENTS), F.floor(capacity / F.lit(tokens_per_segment))).cast("long")
    return segments, F.greatest(F.lit(1), F.floor(capacity * F.lit(float(loss_share)))).cast("long")


def _counted(containers: DataFrame) -> DataFrame:
    if containers.limit(MAX_KINDS + 1).count() > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    return containers


def items(sized: DataFrame, containers: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(container, capacity, most_segments, most_loss, doc_id, piece, n_pieces, tokens, loss_tokens): what has to be placed.

    A document that exceeds the capacity becomes pieces and a rest, its loss-bearing tokens spread
    evenly and its pieces as long as both limits allow. All others stay whole. Documents without tokens are no items. Containers
    without a positive capacity are left out. ``containers`` is a configuration table.
    """
    capacity = F.col("capacity_tokens").cast("long")
    segments, loss = limits(capacity, tokens_per_segment, loss_share)
    kinds = _counted(containers.filter("capacity_tokens > 0")).select("container", capacity.alias("capacity"), segments.alias("most_segments"), loss.alias("most_loss"))
    pairs = sized.filter("tokens > 0").crossJoin(F.broadcast(kinds))  # each document goes into each kind of container
    dense = F.greatest(F.lit(1), F.expr("div(most_loss * tokens, loss_tokens)"))
    pairs = pairs.withColumn("_step", F.when((F.col("loss_tokens") > 0) & (F.col("tokens") > F.col("capacity")), F.least("capacity", dense)).otherwise(F.col("capacity")))
    n = F.ceil(F.col("tokens") / F.col("_step")).cast("int")
    cut = pairs.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    size = F.when(F.col("piece") < F.col("n_pieces"), F.col("_step")).otherwise(F.col("tokens") - F.col("_step") * (F.col("n_pieces") - 1))
    before = F.expr("div(loss_tokens * (_step * (piece - 1)), tokens)")
    upto = F.when(F.col("piece") < F.col("n_pieces"), F.expr("div(loss_tokens * (_step * piece), tokens)")).otherwise(F.col("loss_tokens"))
    return cut.select(*KIND, "doc_id", "piece", "n_pieces", size.cast("long").alias("tokens"), (upto - before).cast("long").alias("loss_tokens"))


def _pack_shard(mark: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        limit = np.array([int(pdf[c].iat[0]) for c in KIND[1:]])
        # An item beyond the limit of loss takes all of it, so no other item with loss joins it.
        demand = np.c_[pdf["tokens"], np.ones(len(pdf), np.int64), np.minimum(pdf["loss_tokens"], limit[2])].astype(np.int64)
        name = f"{mark}-{int(pdf['shard'].iat[0])}-"
        return pdf[KIND + ITEM].assign(bin=[name + str(i) for i in pack(demand, limit)])

    return run


def fill(sized: DataFrame, containers: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE, seed: int = 3) -> DataFrame:
    """(container, capacity, most_segments, most_loss, bin, doc_id, piece, n_pieces, tokens, loss_tokens): every item in one container.

    A shard's size follows from the counts, not from any key, so no source or document length can
    overfill a task. Copies of a document are items of their own.
    """
    ws = Workspace(sized.sparkSession, "containers")
    todo = items(sized, containers, tokens_per_segment, loss_share).withColumn("unnamed", F.col("doc_id").isNull())
    todo = ws.save(todo.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long")), "items")  # pandas has no null integers
    whole = F.col("tokens") == F.col("capacity")
    copy = F.row_number().over(Window.partitionBy("container", "doc_id", "piece").orderBy("unnamed"))
    full = todo.filter(whole).select(*KIND, *ITEM, F.concat_ws("-", F.lit("whole"), F.col("doc_id"), F.col("piece"), F.when(copy > 1, copy)).alias("bin"))
    placed = [full]
    todo = todo.filter(~whole).select(*KIND, *ITEM)
    for r in range(ROUNDS):
        sizes = todo.groupBy("container", "capacity").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()  # one row per kind
        if not sizes:
            break
        last = r == ROUNDS - 1
        per = SHARD_CONTAINERS << r
        shards = {s["container"]: max(1, -(-s["t"] // (s["capacity"] * per)), -(-s["n"] // SHARD_ITEMS)) for s in sizes}
        count = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])[F.col("container")]
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + r), "doc_id", "piece"), count).cast("int"))
        packed = ws.save(dealt.groupBy("container", "shard").applyInPandas(_pack_shard(f"r{r}"), PACKED), "packed")
        if last or max(shards.values()) == 1:
            placed.append(packed)
            break
        open_ = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("_t")).filter(F.col("_t") < FULL * F.col("capacity")).select("container", "bin")
        placed.append(packed.join(open_, ["container", "bin"], "left_anti").select(*[c.name for c in packed.schema]))
        todo = ws.save(packed.join(open_, ["container", "bin"]).select(*KIND, *ITEM), "open")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).select(*KIND, "bin", "doc_id", "piece", "n_pieces", "tokens", "loss_tokens")


def _bins(packed: DataFrame) -> DataFrame:
    return packed.groupBy(*KIND, "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss_tokens").alias("l"), F.count_if(F.col("loss_tokens") > 0).alias("bearing"))


def report(packed: DataFrame) -> DataFrame:
    """Per kind of container: how many, the least number that the tokens need, and how full they are in each dimension."""
    share = lambda c, most: F.round(F.sum(c) / F.sum(most), 6)
    return _bins(packed).groupBy("container").agg(
        F.count("*").alias("n_bins"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / F.first("capacity")).alias("least_bins"),
        share("t", "capacity").alias("fill"), share("n", "most_segments").alias("segment_fill"), share("l", "most_loss").alias("loss_fill"),
        F.count_if(F.col("n") == F.col("most_segments")).alias("n_full_of_segments"), F.count_if(F.col("l") >= F.col("most_loss")).alias("n_full_of_loss"),
    )


def violations(packed: DataFrame, sized: DataFrame) -> DataFrame:
    """(container, bin, doc_id): containers above a limit, and documents whose tokens are not all placed once; empty if all is well."""
    lone = (F.col("l") > F.col("most_loss")) & (F.col("bearing") > 1)
    over = _bins(packed).filter((F.col("t") > F.col("capacity")) | (F.col("n") > F.col("most_segments")) | lone).select("container", "bin", F.lit(None).cast("long").alias("doc_id"))
    want = sized.filter("tokens > 0").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss")).withColumnRenamed("doc_id", "_d")
    got = packed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"))
    lost = got.join(want, F.col("doc_id").eqNullSafe(F.col("_d")), "full").filter(~F.col("tokens").eqNullSafe(F.col("t")) | ~F.col("loss").eqNullSafe(F.col("l")))
    return over.unionByName(lost.select("container", F.lit(None).cast("string").alias("bin"), F.coalesce("doc_id", "_d").alias("doc_id")))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_sized(spark, sf_dir), spark.read.parquet(f"{sf_dir}/containers.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).filter("n_pieces > 1").select("container", "doc_id").distinct()


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).drop("capacity", "most_segments", "most_loss")


def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_run(spark, sf_dir))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_run(spark, sf_dir), _sized(spark, sf_dir))
