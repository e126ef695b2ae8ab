"""Mixing sources to target weights (problem 8): Pfair blocks, earliest deadline first.

Each source's records are put in hashed order, repeated pass by pass up to its allowance, and cut
into equal parts by running sums. Part j of a source with weight w may run from slot
floor(j / w) on and must run before slot ceil((j + 1) / w); taking the released part with the
earliest deadline in every slot keeps each source less than one part from its share at any time.
Records are never cut, and a record belongs to the part in which it starts. A block is therefore one
part and one longest record: the records themselves, too, stay less than one block from the shares.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.functions.ids import regular_name
from voxmill.llm.tokens import with_tokens
from voxmill.operators.ordering import hashed_rank
from voxmill.runtime import Workspace, broadcast_if_small

#: Most blocks that a mix is scheduled in, if its longest record leaves room for so many, and rows that the table of
#: targets may have: together they bound the schedule, which is made on the driver.
BLOCKS, MAX_TARGETS = 1000, 10_000


def pfair(blocks: list[int]) -> list[tuple[int, int]]:
    """(source, block) of every slot, for sources with so many blocks each; their number is that of slots."""
    total = sum(blocks)
    ready: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []
    weight = [Fraction(n, total) if total else Fraction(0) for n in blocks]

    def window(i: int, j: int) -> tuple[int, int]:
        return int(j / weight[i]), -int(-(j + 1) // weight[i])

    for i, n in enumerate(blocks):
        if n:
            heapq.heappush(waiting, (window(i, 0)[0], i, 0))
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(i, j)[1], i, j))
        _, i, j = heapq.heappop(ready)
        out.append((i, j))
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (max(slot + 1, window(i, j + 1)[0]), i, j + 1))
    return out


def mix(sized: DataFrame, targets: DataFrame, seed: int = 17, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(records, report) of every mix.

    ``sized``: doc_id, source (any writing), tokens. ``targets``: mix_id, source, target_weight,
    max_repeats (the most uses of a record in all), budget_frac (of all documents' tokens). Records:
    mix_id, slot, source, pass, doc_id, tokens, at (tokens of the source before it). A source ends with the
    record that reaches its target, or when its allowance is used up; the report says which:
    target_tokens, available_tokens (tokens x max_repeats), reached_tokens, reached_share, block_tokens,
    n_parts and short (reached_tokens < target_tokens). A block has the mix's tokens / ``blocks``, and at
    least two of the longest record's.
    A source without documents has zeros. Null weights, repeats and budgets count as zero; null
    sources match nothing; documents without tokens are never drawn. Nothing is lost by a hot
    source: ranks and running sums are made over buckets of its hash range.
    """
    spark = sized.sparkSession
    ws = Workspace(spark, "mix")
    docs = ws.save(sized.select("doc_id", regular_name(F.col("source")).alias("source"), "tokens"), "docs")
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    rules = targets.select(
        "mix_id", "source", regular_name(F.col("source")).alias("key"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"),
        F.coalesce("max_repeats", F.lit(0)).alias("repeats"), F.coalesce("budget_frac", F.lit(0.0)).alias("budget"),
    )
    asked = rules.orderBy("mix_id", "source").limit(MAX_TARGETS + 1).collect()
    if len(asked) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = F.broadcast(rules.select(F.col("key").alias("source")).distinct())  # at most MAX_TARGETS rows
    per_source = docs.join(names, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    have = {r["source"]: (r["tokens"], r["longest"]) for r in per_source.collect()}  # at most MAX_TARGETS sources

    plan, slots = [], []
    for m in dict.fromkeys(r["mix_id"] for r in asked):
        own = [r for r in asked if r["mix_id"] == m]
        longest = max((have.get(r["key"], (0, 0))[1] or 0) for r in own)
        block = max(1.0, sum(r["weight"] * r["budget"] * total for r in own) / blocks, 2.0 * longest)
        parts = []
        for r in own:
            tokens = have.get(r["key"], (0, 0))[0] or 0
            target = r["weight"] * r["budget"] * total
            available = tokens * r["repeats"]
            reach = min(target, available)
            passes = -(-int(reach + 0.999999) // tokens) if tokens and reach > 0 else 0
            n = math.ceil(reach / max(block - longest, 1.0)) if reach > 0 else 0
            plan.append((m, r["source"], r["key"], float(r["weight"]), float(target), int(tokens), int(available), float(reach), min(passes, r["repeats"]), float(block), n))
            parts.append(n)
        slots += [(m, own[i]["key"], j, t) for t, (i, j) in enumerate(pfair(parts))]
    kind = {f.name: f.dataType.simpleString() for f in targets.schema.fields}["mix_id"]
    rows = spark.createDataFrame(plan, f"mix_id {kind}, named string, source string, target_weight double, target_tokens double, source_tokens long, available_tokens long, reach double, passes int, block double, parts int")
    schedule = broadcast_if_small(spark.createDataFrame(slots, f"mix_id {kind}, source string, part_no long, slot int"), len(slots), 100)

    wanted = F.broadcast(rows.filter("passes > 0").select("mix_id", "source", "source_tokens", "reach", "passes", "parts"))
    uses = docs.filter("tokens > 0").join(wanted, "source").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    order = F.xxhash64(F.lit(seed), "mix_id", "source", "pass", "doc_id")
    n = max(1, round(docs.count() * max([1, *[p[8] for p in plan]])))
    ranked = hashed_rank(uses, ["mix_id", "source", "pass"], order, ["doc_id"], rows=n, weight="tokens")
    at = F.col("before") + (F.col("pass") - 1) * F.col("source_tokens")
    drawn = ranked.withColumn("at", at).filter(F.col("at") < F.col("reach")).withColumn("part_no", F.least(F.floor(F.col("at") * F.col("parts") / F.col("reach")), F.col("parts") - 1).cast("long"))
    records = drawn.join(schedule, ["mix_id", "source", "part_no"]).select("mix_id", "slot", "source", "pass", "doc_id", "tokens", "at")
    records = ws.save(records, "records")

    got = records.groupBy("mix_id", "source").agg(F.sum("tokens").alias("reached_tokens"))
    by_mix = records.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    report = rows.join(got, ["mix_id", "source"], "left").join(by_mix, "mix_id", "left").select(
        "mix_id", F.col("named").alias("source"), "target_weight", "target_tokens", "available_tokens",
        F.coalesce("reached_tokens", F.lit(0).cast("long")).alias("reached_tokens"),
        F.coalesce(F.col("reached_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), F.col("block").alias("block_tokens"), F.col("parts").alias("n_parts"),
        (F.coalesce("reached_tokens", F.lit(0)) < F.col("target_tokens")).alias("short"),
    )
    return records, report


def strays(records: DataFrame, report: DataFrame) -> DataFrame:
    """(mix_id, source, slot, off_tokens): where the records so far are a block or more off a source's share.

    Sums per slot come first; a mix has at most some thousand slots, whatever its size.
    """
    per = records.groupBy("mix_id", "source", "slot").agg(F.sum("tokens").alias("tokens"))
    mixes = report.groupBy("mix_id").agg(F.max("block_tokens").alias("block"), F.sum("n_parts").cast("int").alias("slots"))
    own = per.groupBy("mix_id", "source").agg(F.sum("tokens").alias("all"))
    grid = own.join(mixes, "mix_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).join(per, ["mix_id", "source", "slot"], "left")
    so_far = Window.partitionBy("mix_id", "source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    off = F.sum(F.coalesce("tokens", F.lit(0))).over(so_far) - F.col("all") * (F.col("slot") + 1) / F.col("slots")
    return grid.withColumn("off_tokens", off).filter(F.abs("off_tokens") >= F.col("block")).select("mix_id", "source", "slot", "off_tokens")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(with_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].filter("short").select("mix_id", "source")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1]


def off_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strays(*_run(spark, sf_dir))
