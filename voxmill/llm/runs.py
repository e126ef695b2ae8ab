"""Runs of equal consecutive events in ordered sequences (problem 5; also the turns of problem 1).

A sequence is cut into chunks of consecutive positions, so that a sequence of any length spreads
over many tasks. Inside a chunk the positions at which runs start are gathered into a sorted
array and each event finds its run in it by binary search. Only the first and last run of each
chunk can continue across chunks; these are joined over blocks of chunks and then over the whole
sequence, on tables that are smaller by the chunk's and the block's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.runtime import Workspace

#: Positions in a chunk, and chunks in a block.
CHUNK, BLOCK = 4096, 4096

PIECES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("run_key", T.StringType()),
        T.StructField("participant", T.StringType()),
        T.StructField("first_idx", T.LongType()),
        T.StructField("last_idx", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("at_edge", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


def _chunk_runs(b: pd.DataFrame, key: Callable, text: str | None) -> pd.DataFrame:
    """The runs inside the complete chunks of ``b``, which is sorted by chunk and position."""
    b = b.drop_duplicates(["file", "chunk", "idx"]).reset_index(drop=True)
    k = key(b).astype(object)
    k = k.where(k.notna(), None)
    chunk_id = (b["file"] != b["file"].shift()) | (b["chunk"] != b["chunk"].shift())
    starts_chunk = chunk_id.to_numpy(bool)
    same = np.asarray(k.to_numpy()[1:] == k.to_numpy()[:-1], bool)
    # None equals None; keys that must not join anything are made unique by the caller.
    starts = np.flatnonzero(np.r_[True, ~same] | starts_chunk)
    run = np.searchsorted(starts, np.arange(len(b)), side="right") - 1
    ends = np.r_[starts[1:], len(b)] - 1
    chunk_starts = np.flatnonzero(starts_chunk)
    first = np.isin(starts, chunk_starts)
    last = np.r_[first[1:], True]
    part = np.arange(len(starts)) - np.searchsorted(starts, chunk_starts)[np.searchsorted(chunk_starts, starts, side="right") - 1]
    ms = lambda c, f: pd.array(f.reduceat(b[c].to_numpy(float, na_value=np.nan), starts), dtype="Float64").astype("Int64")
    said = b[text].tolist() if text else None
    return pd.DataFrame(
        {
            "file": b["file"].to_numpy()[starts],
            "chunk": b["chunk"].to_numpy()[starts],
            "part": part,
            "run_key": k.to_numpy()[starts],
            "participant": b["participant"].to_numpy()[starts],
            "first_idx": b["idx"].to_numpy()[starts],
            "last_idx": b["idx"].to_numpy()[ends],
            "n_events": np.bincount(run, minlength=len(starts)),
            "start_ms": ms("start_ms", np.fmin),
            "end_ms": ms("end_ms", np.fmax),
            "at_edge": first | last,
            "text": [" ".join(said[s : e + 1]) for s, e in zip(starts, ends)] if text else [None] * len(starts),
        }
    )


def chunked(events: DataFrame) -> DataFrame:
    """Events laid out by chunk and sorted by position, preferred delivery first."""
    e = events if "chunk" in events.columns else events.withColumn("chunk", F.floor(F.col("idx") / CHUNK).cast("long"))
    return e.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "idx", "pref", "row_id")


def pieces(events: DataFrame, key: Callable[[pd.DataFrame], pd.Series], text: str | None = None) -> DataFrame:
    """Runs inside chunks. ``events`` has file, idx, participant, start_ms, end_ms, pref and row_id.

    Of several deliveries of one position the preferred one counts. ``key`` maps a batch to the
    keys whose equality makes a run; ``text`` names a column to be joined along each run.
    """

    def build(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if b.empty:
                continue
            tail = (b["file"] == b["file"].iat[-1]) & (b["chunk"] == b["chunk"].iat[-1])
            rest, done = b[tail], b[~tail]
            # Of many copies of one position only the first is kept while the chunk is open.
            rest = rest.drop_duplicates(["file", "chunk", "idx"])
            if len(done):
                yield _chunk_runs(done, key, text)
        if rest is not None and len(rest):
            yield _chunk_runs(rest, key, text)

    return chunked(events).mapInPandas(build, PIECES)


def _starts(edges: DataFrame, over: list[str], unit: str) -> DataFrame:
    """Add ``s``: the first position of the run that each row belongs to, within the groups of ``over``.

    Two rows of one ``unit`` are its first and last run; others lie between them, so they never join.
    """
    w = Window.partitionBy(*over).orderBy("first_idx")
    joins = F.lag(unit).over(w).isNotNull() & (F.lag(unit).over(w) != F.col(unit)) & F.lag("run_key").over(w).eqNullSafe(F.col("run_key"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumn("_s", F.when(~joins, F.col("first_idx"))).withColumn("s", F.max("_s").over(so_far)).drop("_s")


def with_run_start(p: DataFrame) -> DataFrame:
    """Add ``run_first``, the position at which the run of each piece starts.

    The pieces are written once, since three branches of the plan read them.
    """
    p = Workspace(p.sparkSession, "runs").save(p, "pieces")
    block = F.floor(F.col("chunk") / BLOCK).cast("long")
    edges = p.filter("at_edge").select("file", "chunk", "part", "run_key", "first_idx", block.alias("block"))
    in_block = _starts(edges, ["file", "block"], "chunk")
    heads = in_block.groupBy("file", "block", "s").agg(F.max("run_key").alias("run_key"))
    ends = Window.partitionBy("file", "block")
    outer = heads.withColumn("_e", (F.col("s") == F.min("s").over(ends)) | (F.col("s") == F.max("s").over(ends))).filter("_e")
    outer = outer.select("file", "block", "run_key", F.col("s").alias("first_idx"))
    moved = _starts(outer, ["file"], "block").filter(F.col("s") != F.col("first_idx"))
    moved = moved.select("file", "block", F.col("s").alias("_moved"), F.col("first_idx").alias("s"))
    resolved = in_block.join(moved, ["file", "block", "s"], "left").select(
        "file", "chunk", "part", F.coalesce("_moved", "s").alias("run_first")
    )
    inner = p.filter(~F.col("at_edge")).withColumn("run_first", F.col("first_idx"))
    return inner.unionByName(p.filter("at_edge").join(resolved, ["file", "chunk", "part"]))


def runs(p: DataFrame) -> DataFrame:
    """Whole runs from pieces with ``run_first``; a run of many pieces is pre-aggregated where they lie."""
    return p.groupBy("file", F.col("run_first").alias("first_idx")).agg(
        F.max("run_key").alias("run_key"),
        F.max("participant").alias("participant"),
        F.max("last_idx").alias("last_idx"),
        F.sum("n_events").alias("n_events"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
    )
