"""Exact percentiles of very large numeric columns by distributed multi-select (problem 6).

The data lie as sorted runs: each batch of rows gives, per group, one sorted array of values. Runs
of different partitions or days are simply put together, which is what makes results combinable.
Then, per group and range still in question, every run proposes its median, the medians of its
halves, and so on down ``LEVELS`` levels; the tasks' weighted medians of the proposals become the
pivots, all runs count three ways (below, equal, above) by binary search, and what cannot hold the
wanted rank is ruled out. A round so does the work of up to ``LEVELS`` single pivots with two small
shuffles, and ruled out values are dropped from the stored runs whenever most of what is stored is
ruled out. A range of at most ``LEFT`` values needs no further round: it is put together in sorted
order and read at its rank. Groups of that size are so from the start.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.ids import regular_speaker
from voxmill.runtime import Workspace, broadcast_if_small

#: Rows that are sorted at once to make runs, and values of a run at most.
ROWS_AT_ONCE, RUN_VALUES = 1 << 18, 1 << 16
#: Values that a range in question may still have for one task to sort it, and levels of medians that a run proposes.
LEFT, LEVELS = 1 << 15, 4
#: Stored runs are rewritten once less than this part of their values is still in question.
REWRITE_BELOW = 0.25
MAX_ROUNDS = 200

KEY = ["dimension", "grp", "measure"]
RANGE = [*KEY, "lo", "hi"]
RUN_SCHEMA = "dimension string, grp string, measure string, n long, vals array<double>"


def _emit(dimension: str, grp: np.ndarray, names, measure: str, vals: np.ndarray) -> Iterable[pa.RecordBatch]:
    """Sorted runs of one dimension and measure; nulls, NaN and infinities are no values."""
    ok = np.isfinite(vals)
    g, v = grp[ok], vals[ok]
    order = np.lexsort((v, g))
    g, v = g[order], v[order]
    if not len(g):
        return
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[cut, len(g)])
    if sizes.max() > RUN_VALUES:  # a hot group becomes several runs
        cut = np.unique(np.concatenate([np.arange(c, c + n, RUN_VALUES) for c, n in zip(cut, sizes)]))
    offsets = pa.array(np.r_[cut, len(g)].astype(np.int32))
    keys = pa.array([names[i] for i in g[cut]], pa.string())
    n = len(cut)
    yield pa.RecordBatch.from_arrays(
        [pa.array([dimension] * n, pa.string()), keys, pa.array([measure] * n, pa.string()), pa.array(np.diff(np.r_[cut, len(g)])), pa.ListArray.from_arrays(offsets, pa.array(v))],
        [*KEY, "n", "vals"],
    )


def sorted_runs(df: DataFrame, dimensions: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """One pass without a shuffle: (dimension, grp, measure, n, vals), vals sorted.

    A null group is the group null. Null, NaN and infinite measures are left out, zeros are values.
    Measures are compared as doubles.
    """
    cols = [c.cast("string").alias(f"d{i}") for i, c in enumerate(dimensions.values())] + [c.cast("double").alias(f"m{i}") for i, c in enumerate(measures.values())]
    dims, meas = list(dimensions), list(measures)

    def build(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        vals = [t.column(f"m{j}").to_numpy().astype(float) for j in range(len(meas))]
        for i, d in enumerate(dims):
            coded = t.column(f"d{i}").combine_chunks().dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for m, v in zip(meas, vals):
                yield from _emit(d, codes, names, m, v)

    return df.select(*cols).mapInArrow(build, RUN_SCHEMA)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    offsets = col.offsets.to_numpy()
    return col.flatten().to_numpy(zero_copy_only=False), (offsets - offsets[0]).astype(np.int64)


def _search(v: np.ndarray, o0: np.ndarray, o1: np.ndarray, x: np.ndarray, inclusive: bool) -> np.ndarray:
    """Where ``x`` falls in each sorted slice ``v[o0:o1]``: the binary searches of all slices side by side."""
    lo, hi = o0.copy(), o1.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = v[np.where(open_, mid, 0)]
        right = open_ & ((at <= x) if inclusive else (at < x))
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def _ranges(b: pa.RecordBatch):
    """Per run and range: run number, number of the range in its group, all values, and the slice in question."""
    v, off = _lists(b.column("vals"))
    los, of = _lists(b.column("los"))
    his = _lists(b.column("his"))[0]
    run = np.repeat(np.arange(b.num_rows), np.diff(of))
    nth = np.arange(len(run)) - of[:-1][run]
    o0, o1 = off[:-1][run], off[1:][run]
    return run, nth, los, his, v, _search(v, o0, o1, los, True), _search(v, o0, o1, his, False)


def _keys_at(b: pa.RecordBatch, run: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    return [*[b.column(c).take(pa.array(run)) for c in KEY], pa.array(lo), pa.array(hi)]


def _quantiles(values: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """The weighted 1/parts .. (parts-1)/parts points of ``values``."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return values[order][np.minimum(at, len(values) - 1)]


PROPOSED = "dimension string, grp string, measure string, lo double, hi double, v double, w long"


def _propose(batches):
    """Proposals of a task's runs per range, reduced to one set per range and task."""
    parts = 1 << LEVELS
    held: dict[tuple, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        run, _, los, his, v, a, z = _ranges(b)
        names = [b.column(c).to_pylist() for c in KEY]
        for i in np.flatnonzero(a < z):
            n = int(z[i] - a[i])
            at = a[i] + (n * np.arange(1, parts)) // parts
            held.setdefault((*[c[run[i]] for c in names], float(los[i]), float(his[i])), []).append((v[at], n))
    rows = []
    for key, own in held.items():
        n = sum(x[1] for x in own)
        found = _quantiles(np.concatenate([x[0] for x in own]), np.repeat([x[1] for x in own], parts - 1), parts)
        rows += [(*key, float(x), n) for x in found]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, [pa.string()] * 3 + [pa.float64()] * 3 + [pa.int64()])], [*RANGE, "v", "w"])


COUNTS = "dimension string, grp string, measure string, lo double, hi double, pivot double, lower long, upto long"


def _count(batches):
    """Three-way counts of every range at each of its pivots: values below it, and up to it."""
    for b in batches:
        if not b.num_rows:
            continue
        run, nth, los, his, v, a, z = _ranges(b)
        sets = b.column("pivots")
        flat, of = _lists(sets.flatten())  # the pivots of range nth of a run's group lie behind one another
        first = sets.offsets.to_numpy() - sets.offsets.to_numpy()[0]
        own = first[:-1][run] + nth
        n = of[own + 1] - of[own]
        some = np.repeat(np.arange(len(run)), n)
        pivot = flat[np.repeat(of[own], n) + np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)]
        lower, upto = _search(v, a[some], z[some], pivot, False) - a[some], _search(v, a[some], z[some], pivot, True) - a[some]
        yield pa.RecordBatch.from_arrays([*_keys_at(b, run[some], los[some], his[some]), pa.array(pivot), pa.array(lower), pa.array(upto)], [*RANGE, "pivot", "lower", "upto"])


def _trim(batches):
    """The runs with only the values that are still in question for some percentile."""
    for b in batches:
        if not b.num_rows:
            continue
        _, _, _, _, v, a, z = _ranges(b)
        off = _lists(b.column("vals"))[1]
        mark = np.zeros(len(v) + 1, np.int64)
        some = a < z
        np.add.at(mark, a[some], 1)
        np.add.at(mark, z[some], -1)
        keep = np.cumsum(mark)[:-1] > 0
        kept = np.r_[0, np.cumsum(keep)][off]
        lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(v[keep]))
        t = pa.RecordBatch.from_arrays([*[b.column(c) for c in KEY], pa.array(np.diff(kept)), lists], [*KEY, "n", "vals"])
        yield t.filter(pa.array(np.diff(kept) > 0))


SLICES = "dimension string, grp string, measure string, lo double, hi double, vals array<double>"


def _slice(batches):
    """The values of each range, as one array per run and range."""
    for b in batches:
        if not b.num_rows:
            continue
        run, _, los, his, v, a, z = _ranges(b)
        i = np.flatnonzero(a < z)
        size = z[i] - a[i]
        off = np.r_[0, np.cumsum(size)]
        flat = v[np.repeat(a[i] - off[:-1], size) + np.arange(off[-1])]
        yield pa.RecordBatch.from_arrays([*_keys_at(b, run[i], los[i], his[i]), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))], [*RANGE, "vals"])


MERGED = "dimension string, grp string, measure string, lo double, hi double, n long, at array<long>, found array<double>"


def _merge(probs: list[float]):
    """Ranges whose runs lie behind one another, each put in order and read at its ranks.

    A whole group gives ``found`` for ``probs``; a part of one gives it for the ranks in ``at``.
    """
    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            heads = _heads(t)
            rest, done = t.slice(heads[-1]), t.slice(0, heads[-1])
            if done.num_rows:
                yield from read(done.combine_chunks(), heads[:-1])
        if rest is not None:
            yield from read(rest.combine_chunks(), np.array([0]))

    def read(t: pa.Table, heads: np.ndarray):
        v, off = _lists(t.column("vals").combine_chunks())
        start = off[np.r_[heads, t.num_rows]]
        size = np.diff(start)
        of = np.repeat(np.arange(len(heads)), size)
        v = v[np.lexsort((v, of))]
        first = t.take(pa.array(heads))
        ranks, at = [], first.column("at").to_pylist()
        whole = np.maximum(1, np.ceil(np.round(np.multiply.outer(size, probs), 6))).astype(np.int64)
        for i, k in enumerate(at):
            ranks.append(whole[i] if k is None else np.array(k, np.int64))
        n = np.array([len(k) for k in ranks])
        found = v[np.concatenate(ranks) - 1 + np.repeat(start[:-1], n)] if len(ranks) else v[:0]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(found))
        cols = [*[first.column(c) for c in RANGE], pa.array(size), first.column("at"), lists]
        yield from pa.table(cols, names=[*RANGE, "n", "at", "found"]).to_batches()

    return run


def _heads(t: pa.Table) -> np.ndarray:
    """Rows at which another range starts."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in RANGE:
        codes = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on &= F.col(a).eqNullSafe(F.col(b))
    return on


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") if c in cols else F.col(c) for c in df.columns])


def percentiles(runs: DataFrame, probs: list[float]) -> DataFrame:
    """(dimension, grp, measure, n, p, value): exact percentiles of the union of all runs given.

    The value at ``p`` is the smallest one that at least ``p * n`` values do not exceed (rank
    ``ceil(p n)``, at least 1), so it is always a value of the data and the error is zero.
    ``runs`` may be the union of runs built on different days. Groups without values do not come out.
    """
    ws = Workspace(runs.sparkSession, "percentiles")
    stored = ws.save(runs.select(*KEY, "n", "vals"), "runs")
    groups = ws.save(stored.groupBy(*KEY).agg(F.sum("n").alias("n")).filter(F.col("n") > LEFT), "groups")
    big = groups.count()
    whole = stored.withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf"))).withColumn("at", F.lit(None).cast("array<long>"))
    under = [f"_{c}" for c in KEY]
    if big:
        whole = whole.join(broadcast_if_small(_renamed(groups.select(*KEY), KEY), big, 200), _same(KEY, under), "left_anti")
    parts = [whole.select(*RANGE, "vals", "at")]
    state = _select(stored.join(broadcast_if_small(_renamed(groups.select(*KEY), KEY), big, 200), _same(KEY, under), "left_semi"), groups, big, probs, ws) if big else None
    if state is not None:
        state, parts_left = state
        parts.append(parts_left)
    ordered = reduce(DataFrame.unionByName, parts).repartition(*RANGE).sortWithinPartitions(*RANGE)
    merged = ws.save(ordered.mapInArrow(_merge(probs), MERGED), "merged")
    every = F.array(*[F.lit(float(p)) for p in probs])
    out = merged.filter("at is null").select(*KEY, "n", F.explode(F.arrays_zip(every.alias("p"), F.col("found").alias("value"))).alias("x")).select(*KEY, "n", "x.p", "x.value")
    if state is None:
        return out
    out = out.unionByName(state.filter("value is not null").select(*KEY, "n", "p", "value"))
    read = merged.filter("at is not null").select(*RANGE, F.explode(F.arrays_zip(F.col("at"), F.col("found").alias("v"))).alias("x")).select(*RANGE, "x.at", "x.v")
    open_ = state.filter("value is null").withColumn("at", F.col("k") - F.col("base"))
    read = _renamed(read, [*RANGE, "at"])
    return out.unionByName(open_.join(read, _same([*RANGE, "at"], [*[f"_{c}" for c in RANGE], "_at"])).select(*KEY, "n", "p", F.col("v").alias("value")))


def _select(stored: DataFrame, groups: DataFrame, big: int, probs: list[float], ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(state, slices) of the groups above ``LEFT`` values, after as many rounds as leave at most ``LEFT`` in each range.

    ``state``: a row per group and percentile with the value, or with the range (lo, hi) that holds
    rank ``k``, of which ``base`` values lie below the range. ``slices``: the values of these ranges.
    """
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 6))).cast("long")
    state = groups.withColumn("p", F.explode(wanted)).select(
        *KEY, "n", "p", rank.alias("k"), F.lit(0).cast("long").alias("base"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        F.col("n").alias("left"), F.lit(None).cast("double").alias("value"),
    )
    state = ws.save(state, "state")
    held = groups.agg(F.sum("n")).first()[0]
    under = [f"_{c}" for c in KEY]
    share = F.array(*[F.lit(j / (1 << LEVELS)) for j in range(1, 1 << LEVELS)])

    def asked(ranges: DataFrame, *more: str) -> DataFrame:
        """One row per group: its ranges, in order, as parallel arrays; a group has at most a range per percentile."""
        each = ranges.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", *more))).alias("a"))
        names = {"lo": "los", "hi": "his"}
        return broadcast_if_small(each.select(*[F.col(c).alias(f"_{c}") for c in KEY], *[F.col(f"a.{c}").alias(names.get(c, c)) for c in ("lo", "hi", *more)]), big, 200 + len(probs) * (16 + 8 * (len(more) << LEVELS)))

    for _ in range(MAX_ROUNDS):
        open_ = state.filter(F.col("value").isNull())
        left = open_.select(*RANGE, "left").distinct().agg(F.sum("left"), F.count_if(F.col("left") > LEFT)).first()
        if left[1] and (left[0] or 0) < REWRITE_BELOW * held:
            old = stored
            stored = ws.save(stored.join(asked(open_.select(*RANGE).distinct()), _same(KEY, under)).select(*KEY, "vals", "los", "his").mapInArrow(_trim, RUN_SCHEMA), "runs")
            ws.drop(old)
            held = left[0]
        if not left[1]:
            last = asked(open_.select(*RANGE).distinct())
            slices = stored.join(last, _same(KEY, under)).select(*KEY, "vals", "los", "his").mapInArrow(_slice, SLICES)
            at = open_.groupBy(*RANGE).agg(F.collect_set(F.col("k") - F.col("base")).alias("at"))  # at most a rank per percentile
            at = broadcast_if_small(_renamed(at, RANGE), big * len(probs), 300)
            return state, slices.join(at, _same(RANGE, [f"_{c}" for c in RANGE])).select(*RANGE, "vals", "at")
        ranges = open_.filter(F.col("left") > LEFT).select(*RANGE).distinct()
        proposed = stored.join(asked(ranges), _same(KEY, under)).select(*KEY, "vals", "los", "his").mapInArrow(_propose, PROPOSED)
        # One set of proposals per task and range, so the buffer grows with the tasks, not with the values.
        pivots = ws.save(proposed.groupBy(*RANGE).agg(F.array_distinct(F.percentile("v", share, F.col("w"))).alias("pivots")), "pivots")
        counts = stored.join(asked(pivots, "pivots"), _same(KEY, under)).select(*KEY, "vals", "los", "his", "pivots").mapInArrow(_count, COUNTS)
        counts = counts.groupBy(*RANGE, "pivot").agg(F.sum("lower").alias("lower"), F.sum("upto").alias("upto"))
        counts = counts.groupBy(*RANGE).agg(F.sort_array(F.collect_list(F.struct("pivot", "lower", "upto"))).alias("c"))  # at most 2^LEVELS entries
        old, state = state, ws.save(_decide(state, counts), "state")
        ws.drop(old)
    raise RuntimeError("multi-select did not end")


def _decide(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Rule out the ranges between pivots that cannot hold rank k; a pivot that has the rank is the value."""
    s = state.join(_renamed(counts, RANGE), _same(RANGE, [f"_{c}" for c in RANGE]) & F.col("value").isNull(), "left")
    s = s.withColumn("_r", F.col("k") - F.col("base")).withColumns(
        {
            "_hit": F.get(F.filter("c", lambda x: (x["lower"] < F.col("_r")) & (F.col("_r") <= x["upto"])), F.lit(0)),
            "_below": F.try_element_at(F.filter("c", lambda x: x["upto"] < F.col("_r")), F.lit(-1)),
            "_above": F.get(F.filter("c", lambda x: x["lower"] >= F.col("_r")), F.lit(0)),
        }
    )
    hit, below, above, seen = F.col("_hit"), F.col("_below"), F.col("_above"), F.col("c").isNotNull()
    return s.select(
        *KEY, "n", "p", "k",
        F.when(seen & below.isNotNull(), F.col("base") + below["upto"]).otherwise(F.col("base")).alias("base"),
        F.coalesce(below["pivot"], "lo").alias("lo"),
        F.coalesce(above["pivot"], "hi").alias("hi"),
        F.when(seen, F.coalesce(above["lower"], "left") - F.coalesce(below["upto"], F.lit(0))).otherwise(F.col("left")).alias("left"),
        F.coalesce("value", hit["pivot"]).alias("value"),
    )


def utterance_runs(utterances: DataFrame) -> DataFrame:
    """The runs of one delivery of utterances: durations and words per mic, sampling rate, speaker and day."""
    dims = {"mic": F.col("mic"), "sr": F.col("sr"), "speaker": regular_speaker(F.col("speaker")), "day": F.to_date("recorded_at")}
    return sorted_runs(utterances, dims, {"duration": F.col("duration"), "words": F.col("words")})


#: The percentiles of the report.
REPORTED = [0.05, 0.25, 0.5, 0.75, 0.95]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(utterance_runs(spark.read.parquet(f"{sf_dir}/utterances.parquet")), REPORTED)
