"""Order-dependent packing of utterances into segments of bounded length, on metadata only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.groups import map_groups

# Segment cap and floor, and the gap between items, in seconds.
CAP_S, FLOOR_S, GAP_S = 60.0, 45.0, 0.1

PACKED = "speaker {s}, pool int, buf int, pos int, item {i}, offset_s double, dur double, buf_len double, kept boolean"


def first_fit(durations: list[float], cap: float = CAP_S, gap: float = GAP_S) -> list[list[int]]:
    """Buffers of item numbers: one buffer is open at a time, a pass scans what is left in order and skips what does not fit.

    A tree over the items' order holds the least duration that is left below each node, so the next
    item that fits is found in O(log n), whatever the number of items that a pass skips.
    """
    n = len(durations)
    size = 1 << max(0, n - 1).bit_length()
    least = [math.inf] * size + list(durations) + [math.inf] * (size - n)
    for k in range(size - 1, 0, -1):
        least[k] = min(least[2 * k], least[2 * k + 1])
    out, left, first = [], n, 0

    def remove(i: int) -> None:
        k = size + i
        least[k] = math.inf
        while k := k >> 1:
            least[k] = min(least[2 * k], least[2 * k + 1])

    def following(start: int, length: float, more: float) -> int | None:
        """First item left from ``start`` on that keeps the length within the cap."""
        k = size + start
        if start >= size:
            return None
        while length + (least[k] + more) > cap:
            while k & 1:  # up to the first ancestor that has a right neighbour
                k >>= 1
                if not k:
                    return None
            k += 1
        while k < size:
            k *= 2
            if length + (least[k] + more) > cap:
                k += 1
        return k - size

    while left:
        length, taken, at = 0.0, [], 0
        while (i := following(at, length, gap if taken else 0.0)) is not None:
            length = (length + gap if taken else length) + durations[i]
            taken.append(i)
            remove(i)
            at = i + 1
        if not taken:  # only an item above the cap can be alone; it makes a buffer of its own
            while least[size + first] == math.inf:
                first += 1
            taken = [first]
            remove(first)
        out.append(taken)
        left -= len(taken)
    return out


def pack(items: DataFrame, speaker: str, item: str, duration: str, order: list[str] | None = None) -> DataFrame:
    """Pack each speaker's items shorter than the floor, in ``order`` (by item): one row per item.

    ``kept`` is false for the buffers that stay below the floor. Null and non-positive durations
    and NaN are left out; longer items bypass packing. The audio itself is joined later. A speaker
    is one pool of any size, so ``pool`` is 0 throughout.
    """
    kind = dict(items.dtypes)
    short = items.filter((F.col(duration) > 0) & (F.col(duration) < FLOOR_S) & ~F.isnan(duration))
    by = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [item])]
    ready = short.select(F.col(speaker).alias("speaker"), F.col(item).alias("item"), F.col(duration).cast("double").alias("dur"), *by)

    def build(g: dict[str, list]) -> dict[str, list]:
        dur, out = g["dur"], {n: [] for n in ("buf", "pos", "item", "offset_s", "dur", "buf_len", "kept")}
        for b, taken in enumerate(first_fit(dur)):
            at, offsets = 0.0, []
            for n, i in enumerate(taken):
                at = at + GAP_S if n else at
                offsets.append(at)
                at += dur[i]
            n = len(taken)
            for name, v in (("buf", [b] * n), ("pos", range(n)), ("item", [g["item"][i] for i in taken]), ("offset_s", offsets), ("dur", [dur[i] for i in taken]), ("buf_len", [at] * n), ("kept", [at >= FLOOR_S] * n)):
                out[name].extend(v)
        return out | {"speaker": g["speaker"], "pool": [0] * len(dur)}

    return map_groups(ready, "speaker", [f"_o{k}" for k in range(len(by))], build, PACKED.format(s=kind[speaker], i=kind[item]))


def buffers(packed: DataFrame) -> DataFrame:
    """One row per buffer: first and last item in packing order, their number and the length."""
    return packed.groupBy("speaker", "pool", "buf").agg(
        F.min_by("item", "pos").alias("first_item"), F.max_by("item", "pos").alias("last_item"),
        F.count("*").alias("n_items"), F.max("buf_len").alias("len_s"), F.bool_and("kept").alias("kept"),
    )


def broken(packed: DataFrame, items: DataFrame, speaker: str, item: str, duration: str) -> DataFrame:
    """(item, fault): items not packed exactly once, and buffers above the cap or with a wrong length; empty if all is well."""
    want = items.filter((F.col(duration) > 0) & (F.col(duration) < FLOOR_S) & ~F.isnan(duration)).select(F.col(speaker).alias("_s"), F.col(item).alias("_i"))
    want = want.groupBy("_s", "_i").agg(F.count("*").alias("want"))
    got = packed.groupBy("speaker", "item").agg(F.count("*").alias("n"))
    odd = want.join(got, F.col("_s").eqNullSafe(F.col("speaker")) & F.col("_i").eqNullSafe(F.col("item")), "full").filter(~F.col("want").eqNullSafe(F.col("n")))
    b = packed.groupBy("speaker", "buf").agg(F.max("buf_len").alias("len"), (F.sum("dur") + GAP_S * (F.count("*") - 1)).alias("sum"), F.min("item").alias("item"), F.bool_and("kept").alias("kept"))
    bad = (F.col("len") > CAP_S + 1e-6) | (F.abs(F.col("len") - F.col("sum")) > 1e-6) | (F.col("kept") != (F.col("len") >= FLOOR_S))
    return odd.select(F.coalesce("item", "_i").alias("item"), F.lit("times").alias("fault")).unionByName(b.filter(bad).select("item", F.lit("buffer").alias("fault")))
