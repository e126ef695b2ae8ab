"""Grouping a speaker's utterances so that group lengths follow an observed distribution."""

from __future__ import annotations

import bisect
import itertools
import math
import random
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.groups import map_groups

# Tolerance band around a target length, and tries per target.
LOW, HIGH, TRIES = 0.8, 1.2, 20
#: Buckets that the utterances of no known speaker are numbered in.
BUCKETS = 1024


class Pool:
    """Numbers of items in the order of their lengths, with running counts: a draw among the items up to a length is a bisection."""

    def __init__(self, lengths: list[int]):
        self.length = lengths
        self.kinds = sorted(set(lengths))
        self.kind = [bisect.bisect_left(self.kinds, n) for n in lengths]
        self.items: list[list[int]] = [[] for _ in self.kinds]
        self.at = []
        for i, k in enumerate(self.kind):
            self.at.append(len(self.items[k]))
            self.items[k].append(i)
        self.upto = [0, *itertools.accumulate(map(len, self.items))]

    def fitting(self, length: float) -> int:
        return self.upto[bisect.bisect_right(self.kinds, length)]

    def item(self, r: int) -> int:
        k = bisect.bisect_right(self.upto, r) - 1
        return self.items[k][r - self.upto[k]]

    def drop(self, gone: list[int]) -> None:
        """Remove items; the last of the same length moves into an item's place."""
        for i in gone:
            own = self.items[self.kind[i]]
            own[self.at[i]] = own[-1]
            self.at[own[-1]] = self.at[i]
            own.pop()
        self.upto = [0, *itertools.accumulate(map(len, self.items))]


def greedy(pool: Pool, target: float, rng: random.Random) -> list[int]:
    """Items drawn in random order while the length stays within the band, until its lower end is reached.

    An item that does not fit once never fits later, so going through a shuffled pool is the same
    as drawing among the items that still fit. If none does, one item of the pool is drawn.
    """
    got: dict[int, None] = {}
    total, longest, least, most = 0, 0, LOW * target, math.floor(HIGH * target)
    while total < least:
        n = pool.fitting(most - total)
        taken = len(got) if longest <= most - total else sum(pool.length[i] <= most - total for i in got)
        if n == taken:
            break
        if 2 * taken < n:
            while (i := pool.item(int(rng.random() * n))) in got:
                pass
        else:
            i = rng.choice([j for r in range(n) if (j := pool.item(r)) not in got])
        got[i] = None
        total += pool.length[i]
        longest = max(longest, pool.length[i])
    return list(got) or [pool.item(int(rng.random() * pool.upto[-1]))]


def match(utterances: DataFrame, targets: list[int] | dict[int, int], speaker: str, item: str, length: str, seed: int = 0, tries: int = TRIES) -> DataFrame:
    """(speaker, part, group_no, pos, item, length, target): every utterance in exactly one single-speaker group.

    ``targets`` are the observed lengths, or how often each was observed; each draw takes one of
    them by its frequency, with replacement. Per draw the best of ``tries`` shuffles counts: within
    the band before outside it, then the nearer to the target, then the earlier. Without targets,
    and where the speaker is null, so that nobody can say who belongs together, each utterance is
    a group of one with a null target. Draws are made per speaker with keyed seeds, so the result
    does not depend on the order of rows or on partitioning. Null or non-positive lengths are left
    out. ``part`` numbers buckets of the null speaker and is 0 for all others.
    """
    kinds = dict(utterances.dtypes)
    counts = Counter(targets)
    values = sorted(n for n, c in counts.items() if c > 0)
    upto = list(itertools.accumulate(counts[n] for n in values))
    ready = utterances.filter(F.col(length) > 0).select(F.col(speaker).alias("speaker"), F.col(item).alias("item"), F.col(length).cast("int").alias("length"))

    def build(group: dict[str, list]) -> dict[str, list]:
        who = group["speaker"][0]
        rng = random.Random(f"{seed}|{who}|0")
        lengths = group["length"]
        rows, g = [], 0
        pool = Pool(lengths if values else [])
        while pool.upto[-1]:
            target = rng.choices(values, cum_weights=upto)[0]
            best = None
            for _ in range(tries):
                got = greedy(pool, target, rng)
                total = sum(pool.length[i] for i in got)
                score = (not LOW * target <= total <= HIGH * target, abs(target - total))
                if best is None or score < best[0]:
                    best = (score, got)
                if total == target:  # no later try is better
                    break
            pool.drop(best[1])
            rows += [(g, k, i, target) for k, i in enumerate(best[1])]
            g += 1
        if not values:
            rows = [(k, 0, k, None) for k in range(len(lengths))]
        number, pos, of, target = zip(*rows)
        n = len(rows)
        return {"speaker": [who] * n, "part": [0] * n, "group_no": number, "pos": pos, "item": [group["item"][i] for i in of], "length": [lengths[i] for i in of], "target": target}

    schema = f"speaker {kinds[speaker]}, part int, group_no int, pos int, item {kinds[item]}, length int, target int"
    known = map_groups(ready.filter("speaker is not null"), "speaker", ["item", "length"], build, schema)
    alone = ready.filter("speaker is null").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)).cast("int"))
    alone = alone.withColumn("group_no", F.row_number().over(Window.partitionBy("part").orderBy("item", "length")) - 1)
    return known.unionByName(alone.select("speaker", "part", "group_no", F.lit(0).alias("pos"), "item", "length", F.lit(None).cast("int").alias("target")))


def broken(groups: DataFrame, utterances: DataFrame, speaker: str, item: str, length: str) -> DataFrame:
    """(item, n, groups): utterances that are not in exactly one group of their own speaker; empty if all is well."""
    want = utterances.filter(F.col(length) > 0).groupBy(F.col(speaker).alias("_s"), F.col(item).alias("_i")).agg(F.count("*").alias("want"))
    got = groups.groupBy("speaker", "item").agg(F.count("*").alias("n"))
    odd = want.join(got, F.col("_s").eqNullSafe(F.col("speaker")) & F.col("_i").eqNullSafe(F.col("item")), "full")
    return odd.filter(~F.col("want").eqNullSafe(F.col("n"))).select(F.coalesce("item", "_i").alias("item"), F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("n", F.lit(0)).alias("n"))
