"""Samples that match target category proportions (problem 4).

The divisor method: within each category records are put in random order and the record of rank
``r`` has the priority ``(r - 0.5) / target``; the globally smallest priorities are kept, after the
records that a category's minimum demands. A category that runs out simply has no further
priorities, so its seats pass to the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.ordering import hashed_rank
from voxmill.runtime import Workspace, broadcast_if_small

#: Rows that the table of targets may have; it is a configuration table, checked before it is used as one.
MAX_TARGETS = 100_000
#: Smallest priority step, for categories with a target of zero.
TINY = 1e-12


def seats(categories: list[dict], total: int) -> list[int]:
    """Seats of each category of one plan: minimum-floor records first, then the smallest priorities.

    ``categories`` have ``n`` (available), ``target`` and ``floor``. The number of records of a
    category with a priority up to ``x`` is known from ``n`` and ``target`` alone, so the cut is
    found by bisection over ``x``; of records of equal priority that of the category listed first goes before. Floors
    are kept even where they add up to more than ``total``.
    """
    floor = [min(c["n"], max(0, c["floor"])) for c in categories]
    want = max(total, sum(floor))
    aim = [max(float(c["target"] or 0.0), TINY) for c in categories]

    def up_to(x: float) -> list[int]:
        return [max(f, min(c["n"], int(x * t + 0.5))) for c, t, f in zip(categories, aim, floor)]

    lo, hi = 0.0, (max((c["n"] for c in categories), default=0) + 1) / min(aim, default=1.0)
    if sum(up_to(hi)) <= want:
        return up_to(hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(up_to(mid)) <= want:
            lo = mid
        else:
            hi = mid
    # Near the cut the priorities themselves decide: step back and hand out the last seats one by one.
    got = [max(f, k - 2) for f, k in zip(floor, up_to(lo))]
    left = [(r - 0.5) / t if r <= c["n"] else float("inf") for c, t, r in zip(categories, aim, (k + 1 for k in got))]
    while sum(got) < want:
        i = min(range(len(got)), key=lambda i: (left[i], i))
        got[i] += 1
        left[i] = (got[i] + 0.5) / aim[i] if got[i] < categories[i]["n"] else float("inf")
    return got


def sample_to_targets(
    records: DataFrame,
    targets: DataFrame,
    record_id: str = "utterance_id",
    value: str = "words",
    plan: str = "plan_id",
    category: str = "band",
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan of ``targets``.

    ``targets``: plan, category, inclusive bounds ``lo_<value>`` and ``hi_<value>``, ``target_share``,
    ``min_rows``, ``sample_frac``. Usable records are the different ``record_id`` with a ``value``
    above 0 (of several deliveries the largest value counts); U is their number, and a plan asks for
    ``round(sample_frac * U)`` of them. Records outside all bands are counted in U and never drawn.

    The sample has plan, category, record_id, value, rank and priority. The report has one row per
    target with available, required (the larger of the minimum and the share), taken, reached_share,
    drawable (records with a rank up to what is required) and short (drawable < required), so that
    both what was taken and what is missing are read off the ranked records. Null bounds are open, null shares and minimums are zero. An
    empty ``records`` gives an empty sample and a report of zeros.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "sample")
    plans = targets.select(plan, category, f"lo_{value}", f"hi_{value}", "target_share", "min_rows", "sample_frac")
    rules = plans.orderBy(plan, f"lo_{value}", category).limit(MAX_TARGETS + 1).collect()
    if len(rules) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    r = records.filter(F.col(value) > 0).select(F.col(record_id).alias("_id"), F.col(value).alias("_v")).filter(F.col("_id").isNotNull())
    usable = ws.save(r.groupBy("_id").agg(F.max("_v").alias("_v")), "usable")
    # Counts by value, pre-aggregated where the rows lie; bands are then counted on that small table.
    by_value = ws.save(usable.groupBy("_v").agg(F.count("*").alias("n")), "values")
    inside = F.col("_v").between(F.coalesce(f"lo_{value}", F.col("_v")), F.coalesce(f"hi_{value}", F.col("_v")))
    small = F.broadcast(plans.select(plan, category, f"lo_{value}", f"hi_{value}"))  # at most MAX_TARGETS rows
    of_value = ws.save(by_value.join(small, inside).select("_v", plan, category, "n"), "bands")  # values x the bands they lie in, no records
    counted = {(x[plan], x[category]): (x["n"], x["k"]) for x in of_value.groupBy(plan, category).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    u = by_value.agg(F.sum("n")).first()[0] or 0

    rows = []
    for p in dict.fromkeys(x[plan] for x in rules):
        own = [x for x in rules if x[plan] == p]
        cats = [{"n": counted.get((p, x[category]), (0, 0))[0], "target": x["target_share"], "floor": x["min_rows"] or 0} for x in own]
        size = round(max((x["sample_frac"] or 0.0) for x in own) * u)
        for x, c, k in zip(own, cats, seats(cats, size)):
            required = max(float(x["min_rows"] or 0), (x["target_share"] or 0.0) * (x["sample_frac"] or 0.0) * u)
            rows.append((p, x[category], x[f"lo_{value}"], x[f"hi_{value}"], float(x["target_share"] or 0.0), int(x["min_rows"] or 0), int(c["n"]), required, int(k), size))
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    quota = spark.createDataFrame(
        rows,
        f"{plan} {kinds[plan]}, {category} {kinds[category]}, lo {kinds[f'lo_{value}']}, hi {kinds[f'hi_{value}']}, target double, floor int, available long, required double, seats long, size long",
    )

    h = F.xxhash64(F.lit(seed), F.col(plan), F.col(category), F.col("_id"))
    # Ranks go as far as the seats and as what is required, whichever is more.
    most = F.greatest("seats", F.least("available", F.ceil("required"))).cast("long")
    bands = F.broadcast(quota.select(F.col(plan).alias("_p"), F.col(category).alias("_c"), "target", "floor", "seats", "available", most.alias("most")))  # at most MAX_TARGETS rows
    named = of_value.join(bands, F.col(plan).eqNullSafe(F.col("_p")) & F.col(category).eqNullSafe(F.col("_c"))).drop("_p", "_c", "n")
    entries = usable.join(broadcast_if_small(named, sum(k for _, k in counted.values()), 200), "_v")
    # Records are ranked by hash, so those of rank 1 .. most lie at the low end of the hash range.
    # Ranking only a low slice gives the same ranks; whether it held enough is checked below.
    place = h.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    share = (F.col("most") + 5 * F.sqrt(F.col("most")) + 20) / F.greatest(F.col("available"), F.lit(1))
    wanted = sum(max(x[8], min(x[6], math.ceil(x[7]))) for x in rows)

    def rank(pool: DataFrame) -> DataFrame:
        ranked = hashed_rank(pool, [plan, category], h, ["_id"], rows=wanted + 1).filter(F.col("rank") <= F.col("most"))
        priority = F.when(F.col("rank") <= F.col("floor"), F.lit(0.0)).otherwise((F.col("rank") - 0.5) / F.greatest(F.col("target"), F.lit(TINY)))
        return ws.save(ranked.select(plan, category, F.col("_id").alias(record_id), F.col("_v").alias(value), "rank", priority.alias("priority"), (F.col("rank") <= F.col("seats")).alias("drawn")), "sample")

    ranked = rank(entries.filter(place <= share))
    if ranked.count() < wanted:
        ranked = rank(entries)
    drawn = ranked.filter("drawn").drop("drawn")
    taken = ranked.groupBy(plan, category).agg(F.count_if("drawn").alias("taken"), F.max("rank").alias("last"))
    report = quota.join(taken, [plan, category], "left").select(
        plan, category, F.col("target").alias("target_share"), F.col("floor").alias("min_rows"), "available", "required",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.round(F.coalesce("taken", F.lit(0)) / F.when(F.sum(F.coalesce("taken", F.lit(0))).over(_by(plan)) > 0, F.sum(F.coalesce("taken", F.lit(0))).over(_by(plan))), 6).alias("reached_share"),
        F.least(F.coalesce("last", F.lit(0).cast("long")), F.ceil("required")).alias("drawable"),
        (F.coalesce("last", F.lit(0)) < F.col("required")).alias("short"),
    )
    return drawn, report


def _by(*cols: str | Column):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def violations(drawn: DataFrame, targets: DataFrame, report: DataFrame, record_id: str = "utterance_id", value: str = "words", plan: str = "plan_id", category: str = "band") -> DataFrame:
    """(plan, category, n): drawn records outside their band, drawn twice or without a smaller rank; and bands below their reachable minimum; empty if all is well."""
    band = targets.select(F.col(plan).alias("_p"), F.col(category).alias("_c"), F.col(f"lo_{value}").alias("_lo"), F.col(f"hi_{value}").alias("_hi"))
    d = drawn.join(F.broadcast(band), F.col(plan).eqNullSafe(F.col("_p")) & F.col(category).eqNullSafe(F.col("_c")))  # at most MAX_TARGETS rows
    out = d.filter((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).groupBy(plan, category).agg(F.count("*").alias("n"))
    twice = drawn.groupBy(plan, category, record_id).agg(F.count("*").alias("k")).filter("k > 1").groupBy(plan, category).agg(F.count("*").alias("n"))
    ranks = drawn.groupBy(plan, category).agg(F.count("*").alias("n"), F.max("rank").alias("last")).filter("n <> last").select(plan, category, "n")
    below = report.filter(F.col("taken") < F.least("available", "min_rows")).select(plan, category, F.col("taken").alias("n"))
    return out.unionByName(twice).unionByName(ranks).unionByName(below)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(spark.read.parquet(f"{sf_dir}/utterances.parquet").select("utterance_id", "words"), spark.read.parquet(f"{sf_dir}/length_targets.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].filter("short").select("plan_id", "band")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].drop("reached_share", "drawable")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, made = _run(spark, sf_dir)
    return violations(drawn, spark.read.parquet(f"{sf_dir}/length_targets.parquet"), made)
