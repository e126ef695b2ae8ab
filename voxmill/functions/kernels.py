"""numpy kernels for long signals: levels, mixing, rooms, search in a source, resampling.

Written to be called from Arrow-batched UDFs on one segment at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from voxmill.functions.signal import FLOOR, sections

#: Seconds of silence behind a signal, for the slow poles of the weighting filter to die away.
TAIL_S = 40.0
#: Samples that are resampled at a time.
BLOCK = 1 << 14


@lru_cache(maxsize=16)
def _response(fs: float, n: int) -> np.ndarray:
    """Digital response of the weighting filter at the bins of an ``n``-point real transform."""
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(n))
    parts, gain = sections(fs)
    h = np.full(len(z), gain, complex)
    for b0, a1 in parts:
        h *= b0 * (1 - z) / (1 + a1 * z)
    return h


def level_db(signal: np.ndarray, fs: float) -> float:
    """Weighted equivalent level; channels (first axis) are averaged before weighting. NaN for an empty signal."""
    x = signal.mean(axis=0) if signal.ndim > 1 else signal
    if not len(x):
        return math.nan
    n = 1 << math.ceil(math.log2(len(x) + TAIL_S * fs))
    y = np.fft.irfft(np.fft.rfft(x, n) * _response(fs, n), n)[: len(x)]
    return float(20 * np.log10(np.sqrt(np.mean(y**2)) + FLOOR))


def normalized(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    if not x.size:
        return x
    y = x * 10 ** ((target - level_db(x, fs)) / 20)
    return y / p if (p := float(np.abs(y).max())) > 1.0 else y


def mix_scene(speech: np.ndarray, events: np.ndarray, background: np.ndarray, fs: float, ebr_db: float, sar_db: float) -> np.ndarray:
    """Speech over an ambience in which events lie ``ebr_db`` above the background, ``sar_db`` below the speech."""
    g = 10 ** ((level_db(background, fs) + ebr_db - level_db(events, fs)) / 20)
    ambience = events * g + background
    return speech + ambience * 10 ** ((level_db(speech, fs) - sar_db - level_db(ambience, fs)) / 20)


def activity(x: np.ndarray, fs: float, window_ms: float = 50, threshold_db: float = -36.0) -> np.ndarray:
    width = int(round(fs * window_ms / 1000))
    if width <= 0:
        raise ValueError("the window must hold a sample")
    p = np.abs(x).max() if len(x) else 0.0
    y = x / p if p > 0 else x
    y = np.pad(y, (0, -len(y) % width)).reshape(-1, width)
    return (20 * np.log10(np.sqrt((y**2).mean(axis=1)) + FLOOR) >= threshold_db).astype(np.uint8)


def locate(part: np.ndarray, source: np.ndarray) -> tuple[int | None, float]:
    """(offset, confidence) of the place in ``source`` that is most like ``part`` up to a factor.

    None and 0 if the source is shorter or the part is silent; the first of equal places counts.
    """
    n, m = len(part), len(source)
    energy = math.sqrt(float(part @ part))
    if m < n or energy == 0:
        return None, 0.0
    size = 1 << (m + n - 1).bit_length()
    corr = np.fft.irfft(np.fft.rfft(source, size) * np.conj(np.fft.rfft(part, size)), size)[: m - n + 1]
    sums = np.r_[0.0, np.cumsum(source**2)]
    window = np.sqrt(np.maximum(sums[n:] - sums[: m - n + 1], 0.0))  # sums may cancel to below zero
    score = np.abs(corr) / (np.where(window == 0, np.inf, window) * energy)
    at = int(score.argmax())
    middle = float(np.median(score))
    return at, float(score[at] / middle) if middle > 0 else 0.0


def fit_two(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """(A, B, R2, R2 gained over b alone) of ``y = A a + B b`` by the normal equations; least norm if they are singular."""
    x = np.stack([a.ravel(), b.ravel()], axis=1)
    v = y.ravel()
    (ca, cb), *_ = np.linalg.lstsq(x.T @ x, x.T @ v, rcond=None)
    energy = max(float(v @ v), 1e-30)
    both = 1.0 - float(((v - x @ [ca, cb]) ** 2).sum()) / energy
    bb = float(b.ravel() @ b.ravel())
    only = float(b.ravel() @ v) / bb if bb else 0.0
    alone = 1.0 - float(((v - b.ravel() * only) ** 2).sum()) / energy
    return float(ca), float(cb), both, both - alone


# The room, its microphones and its walls.
ROOM_DIM, MIC_SPACING, MIC_HEIGHT, ABSORPTION, MAX_ORDER, SOUND_SPEED, SOURCE_DISTANCE = (10.0, 10.0, 3.0), 0.20, 1.5, 0.80, 5, 343.0, 2.0


@lru_cache(maxsize=32)
def room_response(fs: int, pan: float = 0.0, distance: float = SOURCE_DISTANCE) -> np.ndarray:
    """(2, samples) impulse responses of a shoebox room by image sources up to the fifth reflection."""
    dim = np.array(ROOM_DIM)
    centre = np.array([dim[0] / 2, dim[1] / 2, MIC_HEIGHT])
    angle = pan * math.pi / 2
    source = centre + distance * np.array([math.sin(angle), -math.cos(angle), 0.0])
    mics = [centre - [MIC_SPACING / 2, 0, 0], centre + [MIC_SPACING / 2, 0, 0]]
    k = np.arange(-MAX_ORDER, MAX_ORDER + 1)
    axis = [np.where(k % 2 == 0, k * d + s, (k + 1) * d - s) for d, s in zip(dim, source)]
    grid = np.stack(np.meshgrid(*axis, indexing="ij"), -1).reshape(-1, 3)
    order = np.abs(np.stack(np.meshgrid(k, k, k, indexing="ij"), -1)).sum(-1).ravel()
    grid, order = grid[order <= MAX_ORDER], order[order <= MAX_ORDER]
    far = max(np.linalg.norm(grid - m, axis=1).max() for m in mics)
    out = np.zeros((2, int(far / SOUND_SPEED * fs) + 64))
    reach = np.arange(-20, 21)
    for ch, m in enumerate(mics):
        d = np.linalg.norm(grid - m, axis=1)
        amp = (1 - ABSORPTION) ** (order / 2) / (4 * math.pi * d)
        t = d / SOUND_SPEED * fs
        whole = np.round(t).astype(int)
        taps = np.sinc(reach[None, :] - (t - whole)[:, None]) * (0.5 + 0.5 * np.cos(np.pi * reach / 21))[None, :]
        at = whole[:, None] + reach[None, :]
        ok = at >= 0
        np.add.at(out[ch], at[ok], (amp[:, None] * taps)[ok])
    return out


def in_room(x: np.ndarray, fs: int, pan: float = 0.0) -> np.ndarray:
    """The signal as the two microphones hear it: (2, samples)."""
    h = room_response(fs, pan)
    n = len(x) + h.shape[1] - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(h, size) * np.fft.rfft(x, size), size)[:, :n]


def resampled(x: np.ndarray, fs: int, to: int, taps: int = 32) -> np.ndarray:
    """Band-limited resampling along the last axis by windowed-sinc interpolation."""
    if fs == to:
        return x
    n = int(math.ceil(x.shape[-1] * to / fs))
    cut = min(1.0, to / fs)
    half = int(taps / cut)
    reach = np.arange(-half + 1, half + 1)
    out = np.empty((*x.shape[:-1], n))
    for start in range(0, n, BLOCK):  # the weights of one block at a time; a minute's would take gigabytes
        t = np.arange(start, min(n, start + BLOCK)) * fs / to
        at = np.floor(t).astype(int)[:, None] + reach[None, :]
        d = t[:, None] - at
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)
        padded = np.take(x, np.clip(at, 0, x.shape[-1] - 1), axis=-1) * ((at >= 0) & (at < x.shape[-1]))
        out[..., start : start + BLOCK] = (padded * w).sum(-1)
    return out
