"""Signals between numpy and Arrow, without Python lists of samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

PCM_SCALE = 32768.0


def _lists(lengths: list[int], values: pa.Array, missing: list[bool] | None = None) -> pa.ListArray:
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    mask = pa.array(missing) if missing and any(missing) else None
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def nested(signals: Sequence[np.ndarray | None], kind: str = "float64") -> pa.ListArray:
    """A column of (channels, samples) arrays as lists of lists; None gives null."""
    some = [np.atleast_2d(x) for x in signals if x is not None]
    flat = np.concatenate([x.ravel() for x in some]) if some else np.zeros(0)
    channels = _lists([x.shape[1] for x in some for _ in range(x.shape[0])], pa.array(flat.astype(kind)))
    return _lists([0 if x is None else np.atleast_2d(x).shape[0] for x in signals], channels, [x is None for x in signals])


def pcm(x: np.ndarray) -> np.ndarray:
    """Samples as 16-bit integers; values beyond full scale are clamped."""
    return np.clip(np.round(np.asarray(x, float) * PCM_SCALE), -PCM_SCALE, PCM_SCALE - 1).astype(np.int16)


def as_signal(channels) -> np.ndarray:
    """(channels, samples) as doubles, from lists or arrays of doubles or of 16-bit integers."""
    rows = [np.asarray(c) for c in channels]
    x = np.stack(rows) if rows else np.zeros((0, 0))
    return x / PCM_SCALE if np.issubdtype(x.dtype, np.integer) else x.astype(float)


def signals(col: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """The (channels, samples) arrays of a column of lists of lists, one at a time."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    for i in range(len(col)):
        x = col[i]
        yield None if not x.is_valid else as_signal(_channels(x.values))


def _channels(lists: pa.ListArray) -> list[np.ndarray]:
    return [lists[k].values.to_numpy(zero_copy_only=False) for k in range(len(lists)) if lists[k].is_valid]
