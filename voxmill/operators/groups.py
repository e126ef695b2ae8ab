"""Sequential work on whole groups, many groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_groups(df: DataFrame, by: str, order: list[Column | str], build: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``build`` for the rows of each value of ``by``, in ``order``; null is a group of its own.

    ``build`` maps the group's columns (lists) to the columns of ``schema``. Groups lie behind one
    another in sorted partitions, so a group costs its rows and no call into the engine; a task
    holds one Arrow batch and one group at a time. For work on metadata that is sequential by definition.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            heads = _heads(b.column(by))
            same = bool(rest) and rest[0].column(by)[0].as_py() == b.column(by)[0].as_py()
            done = []
            if rest and not same:
                done, rest = [_whole(rest)], []
            if len(heads) > 1:
                first = b.slice(0, heads[1])
                done.append(_whole([*rest, first]) if rest else first)
                done += [b.slice(a, z - a) for a, z in zip(heads[1:-1], heads[2:])]
                rest = []
            rest.append(b.slice(heads[-1]))
            if done:
                yield made(done)
        if rest:
            yield made([_whole(rest)])

    def made(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in target.names}
        for g in groups:
            for n, v in build(dict(zip(names, (c.to_pylist() for c in g.columns)))).items():
                out[n].extend(v)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    # An explicit number keeps adaptive execution from joining partitions that are small in bytes but not in work.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, by).sortWithinPartitions(F.col(by).asc_nulls_first(), *order).mapInArrow(run, fields)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _heads(keys: pa.Array) -> list[int]:
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
