"""Two-speaker conversations: pairing, alternating turns, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.groups import map_groups
from voxmill.operators.ordering import sorted_rank

# Band of a conversation's length, gap, longest turn (seconds), and attempts.
LEAST_S, MOST_S, GAP_S, MAX_TURN_S, ATTEMPTS = 48.0, 60.0, 0.5, 20.0, 1000


def speaker_pairs(speakers: DataFrame, col: str) -> DataFrame:
    """(pair_no, a, b): neighbours in sorted order, the last of an odd number left out.

    Ranks come from sorted ranges of the distinct speakers, which are numbered side by side.
    """
    ranked = sorted_rank(speakers.select(F.col(col).alias("s")).filter("s is not null").distinct(), ["s"])
    pairs = ranked.groupBy(F.floor(F.col("rank") / 2).cast("long").alias("pair_no")).agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n"))
    return pairs.filter("n = 2").drop("n")


def attempt_order(seed: int, attempt: Column | int, item: Column) -> Column:
    a = F.lit(attempt) if isinstance(attempt, int) else attempt
    return F.md5(F.concat_ws("|", F.lit(str(seed)), a.cast("string"), item.cast("string")))


def first_attempt(items: DataFrame, pairs: DataFrame, speaker: str, item: str, duration: str, seed: int = 0) -> DataFrame:
    """First attempt of each pair as plain windows: (pair_no, n_turns, total_s, valid).

    With both orders fixed the turns are the interleaving of the two lists, and the attempt is valid
    if the first running length that reaches the least lies within the most.
    """
    pool = items.filter((F.col(duration) > 0) & (F.col(duration) <= MAX_TURN_S)).select(F.col(speaker).alias("s"), F.col(item).alias("i"), F.col(duration).cast("double").alias("d"))
    side = pairs.select("pair_no", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(0).alias("side")), F.struct(F.col("b").alias("s"), F.lit(1).alias("side")))).alias("x")).select("pair_no", "x.s", "x.side")
    own = Window.partitionBy("pair_no", "side").orderBy(attempt_order(seed, 0, F.col("i")), "i")
    both = Window.partitionBy("pair_no")
    t = pool.join(side, "s").withColumn("k", F.row_number().over(own))
    t = t.withColumn("n0", F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).over(both)).withColumn("n1", F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(both))
    t = t.withColumn("turn", 2 * (F.col("k") - 1) + F.col("side"))
    limit = F.when(F.col("n0") <= F.col("n1"), 2 * F.col("n0")).otherwise(2 * F.col("n1") + 1)
    running = Window.partitionBy("pair_no").orderBy("turn")
    t = t.filter(F.col("turn") < limit).withColumn("total", F.sum(F.col("d") + F.when(F.col("turn") > 0, F.lit(GAP_S)).otherwise(F.lit(0.0))).over(running))
    hit = t.filter(F.col("total") >= LEAST_S).groupBy("pair_no").agg(F.min_by("total", "turn").alias("total_s"), F.min("turn").alias("last"))
    return hit.select("pair_no", (F.col("last") + 1).alias("n_turns"), "total_s", (F.col("total_s") <= MOST_S).alias("valid"))


class Pool:
    """(speaker, item, duration) tuples from which an item, with all its copies, is removed without moving the rest."""

    def __init__(self, items: list[tuple]):
        self.items = items
        self.at: dict = {}
        for k, x in enumerate(items):
            self.at.setdefault(x[1], set()).add(k)

    def drop(self, item) -> None:
        for k in sorted(self.at.pop(item, ()), reverse=True):
            last = self.items.pop()
            if k < len(self.items):
                self.items[k] = last
                self.at[last[1]].discard(len(self.items))
                self.at[last[1]].add(k)


def build(items: DataFrame, pairs: DataFrame, speaker: str, item: str, duration: str, seed: int = 0, attempts: int = ATTEMPTS) -> DataFrame:
    """All conversations of all pairs: (pair_no, conv, turn, speaker, item, start_s, dur, total_s).

    Per pair, attempts with seeded orders go on until one is valid; its items leave the pools, and
    the pair ends when an attempt budget is used up or a pool is empty. ``conv`` counts within the
    pair; numbers over all pairs are a rank by (pair_no, conv). A pair works through its whole
    pools, so ``part`` is 0 throughout.
    """
    import random

    kinds = dict(items.dtypes)
    pool = items.filter((F.col(duration) > 0) & (F.col(duration) <= MAX_TURN_S)).select(F.col(speaker).alias("s"), F.col(item).alias("i"), F.col(duration).cast("double").alias("d"))
    side = pairs.select("pair_no", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(0).alias("side")), F.struct(F.col("b").alias("s"), F.lit(1).alias("side")))).alias("x")).select("pair_no", "x.s", "x.side")
    t = pool.join(side, "s")

    def build_pair(g: dict[str, list]) -> dict[str, list]:
        pair, chunk = g["pair_no"][0], 0
        rows_of = list(zip(g["side"], g["s"], g["i"], g["d"]))
        pools = [Pool([x[1:] for x in rows_of if x[0] == k]) for k in (0, 1)]
        rng = random.Random(f"{seed}|{pair}|{chunk}")
        rows, conv = [], 0
        while pools[0].items and pools[1].items:
            for _ in range(attempts):
                order = [rng.sample(p.items, min(len(p.items), int(MOST_S / GAP_S) + 2)) for p in pools]  # no more turns than gaps fit
                turns, total = [], 0.0
                while len(turns) // 2 < len(order[len(turns) % 2]):
                    nxt = order[len(turns) % 2][len(turns) // 2]
                    added = nxt[2] + (GAP_S if turns else 0.0)
                    if total + added > MOST_S:
                        break
                    turns.append((nxt, total + (GAP_S if turns else 0.0)))
                    total += added
                    if total >= LEAST_S:
                        break
                if LEAST_S <= total <= MOST_S:
                    break
            else:
                break
            rows += [(pair, chunk, conv, n, x[0], x[1], start, x[2], total) for n, (x, start) in enumerate(turns)]
            for i in dict.fromkeys(x[1] for x, _ in turns):
                for p in pools:
                    p.drop(i)
            conv += 1
        names = ["pair_no", "part", "conv", "turn", "speaker", "item", "start_s", "dur", "total_s"]
        return dict(zip(names, zip(*rows))) if rows else {}

    schema = f"pair_no long, part int, conv int, turn int, speaker {kinds[speaker]}, item {kinds[item]}, start_s double, dur double, total_s double"
    return map_groups(t.select("pair_no", "side", "s", "i", "d"), "pair_no", ["i", "side", "d"], build_pair, schema)


def broken(built: DataFrame, items: DataFrame, speaker: str, item: str, duration: str) -> DataFrame:
    """(pair_no, conv, fault): conversations out of the band, turns that do not alternate or repeat an item; empty if all is well."""
    order = Window.partitionBy("pair_no", "conv").orderBy("turn")
    t = built.withColumn("_same", F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.col("turn") > 0)).withColumn("_end", F.col("start_s") + F.col("dur"))
    c = t.groupBy("pair_no", "conv").agg(F.max("_end").alias("end"), F.max("total_s").alias("total"), F.bool_or("_same").alias("same"), F.count_distinct("speaker").alias("who"), F.max("turn").alias("last"), F.count("*").alias("n"))
    band = ~F.col("total").between(LEAST_S - 1e-9, MOST_S + 1e-9) | (F.abs(F.col("end") - F.col("total")) > 1e-6)
    faults = c.select("pair_no", "conv", F.when(band, "length").when(F.col("same") | (F.col("who") > 2) | (F.col("n") != F.col("last") + 1), "turns").alias("fault")).filter("fault is not null")
    used = built.groupBy("speaker", "item").agg(F.count("*").alias("n"), F.min("pair_no").alias("pair_no"), F.min("conv").alias("conv"))
    own = items.groupBy(F.col(speaker).alias("_s"), F.col(item).alias("_i")).agg(F.count("*").alias("have"), F.max(duration).alias("_d"))
    again = used.join(own, (F.col("speaker") == F.col("_s")) & (F.col("item") == F.col("_i")), "left").filter(F.col("have").isNull() | (F.col("n") > F.col("have")) | (F.col("_d") > MAX_TURN_S))
    return faults.unionByName(again.select("pair_no", "conv", F.lit("item").alias("fault")))


def timeline(turns: DataFrame, conv: list[str], order: str, duration: str) -> DataFrame:
    """Add ``start_s``, and ``shifted_s`` in a segment centred in the most allowed length.

    The start of a turn is the running sum of earlier durations and gaps.
    """
    before = Window.partitionBy(*conv).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*conv)
    start = F.coalesce(F.sum(F.col(duration) + GAP_S).over(before), F.lit(0.0))
    total = F.sum(F.col(duration) + GAP_S).over(whole) - GAP_S
    return turns.withColumn("start_s", start).withColumn("shifted_s", start + F.greatest(F.lit(0.0), F.lit(MOST_S) - total) / 2)
