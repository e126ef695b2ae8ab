"""Signal functions on sample arrays as column expressions, for short arrays.

Long arrays (seconds of audio) go through the numpy kernels in ``kernels``; both give the same
levels. Samples are doubles; a multi-channel signal is an array of channels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.binding import let

# Fixed values of the weighting filter: corner frequencies and the gain at 1 kHz in dB.
F1, F2, F3, F4, A1000 = 20.598997, 107.65265, 737.86223, 12194.217, 1.9997
FLOOR = 1e-12


def sections(fs: float) -> tuple[list[tuple[float, float]], float]:
    """(b0, a1) of the four one-pole sections at rate ``fs``, and the gain behind them."""
    w = [2 * math.pi * f for f in (F1, F2, F3, F4)]
    pq = [(1 + w[0], w[0]), (1 + w[1], w[1]), (1 + w[2], w[2]), (1 + w[3], w[3] ** 2)]
    return [(2 * fs / (2 * fs * p + q), (q - 2 * fs * p) / (2 * fs * p + q)) for p, q in pq], w[3] ** 2 * 10 ** (A1000 / 20)


def as_doubles(a: Column) -> Column:
    return a.cast("array<double>")


def mono(channels: Column) -> Column:
    """Mean over channels, before anything else."""
    zero = F.transform(channels[0], lambda x: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda acc, c: F.zip_with(acc, c, lambda x, y: x + y))
    return let(F.size(channels).cast("double"), lambda n: F.transform(total, lambda x: x / n))


def level_db(a: Column, fs: float) -> Column:
    """Weighted equivalent level in dB of one signal; null for null, empty gives null."""
    (s1, s2, s3, s4), gain = sections(fs)
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y1", "y2", "y3", "y4", "ss")])

    def step(s: Column, v: Column) -> Column:
        n1 = F.lit(s1[0]) * (v - s["x"]) - F.lit(s1[1]) * s["y1"]
        n2 = F.lit(s2[0]) * (n1 - s["y1"]) - F.lit(s2[1]) * s["y2"]
        n3 = F.lit(s3[0]) * (n2 - s["y2"]) - F.lit(s3[1]) * s["y3"]
        n4 = F.lit(s4[0]) * (n3 - s["y3"]) - F.lit(s4[1]) * s["y4"]
        out = F.lit(gain) * n4
        return F.struct(v.alias("x"), n1.alias("y1"), n2.alias("y2"), n3.alias("y3"), n4.alias("y4"), (s["ss"] + out * out).alias("ss"))

    n = F.size(a)
    total = F.aggregate(a, start, step, lambda s: s["ss"])
    return F.when(n > 0, 20 * F.log10(F.sqrt(total / n) + FLOOR))


def gain_of(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def scaled(a: Column, g: Column) -> Column:
    return let(g, lambda k: F.transform(a, lambda x: x * k))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))


def normalized(a: Column, level: Column, target: float) -> Column:
    """Signal at the target level, divided by its peak if that exceeds 1."""
    return let(scaled(a, gain_of(F.lit(target) - level)), lambda loud: let(peak(loud), lambda p: F.when(p > 1.0, F.transform(loud, lambda x: x / p)).otherwise(loud)))


def peak_normalized(a: Column) -> Column:
    return let(peak(a) + 1e-9, lambda p: F.transform(a, lambda x: x / p))


def silence(fs: int, seconds: float) -> Column:
    return F.array_repeat(F.lit(0.0), int(seconds * fs))


def padded(a: Column, samples: int) -> Column:
    """Centred in silence; the left pad is the smaller half. Longer signals are unchanged."""
    total = F.greatest(F.lit(samples) - F.size(a), F.lit(0))
    left = F.floor(total / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), left), a, F.array_repeat(F.lit(0.0), total - left))


def fitted(a: Column, samples: int) -> Column:
    """Cut to the length, or centred in silence."""
    return F.when(F.size(a) > samples, F.slice(a, 1, samples)).otherwise(padded(a, samples))


def faded(a: Column, fs: int, seconds: float = 0.01) -> Column:
    """Linear fade over both edges, both ends of the ramp included; too short signals are unchanged."""
    n = F.least(F.lit(int(fs * seconds)), F.floor(F.size(a) / 2).cast("int"))
    ramp = lambda k: F.when(n > 1, k / (n - 1)).otherwise(F.lit(0.0))
    size = F.size(a)
    shaped = F.transform(a, lambda x, i: F.when(i < n, x * ramp(i)).when(i >= size - n, x * ramp(size - 1 - i)).otherwise(x))
    return F.when(n > 0, shaped).otherwise(a)


def with_gaps(parts: list[Column], gap: Column) -> Column:
    """Parts in order with silence between them only."""
    out = []
    for i, p in enumerate(parts):
        out += [gap, p] if i else [p]
    return F.concat(*out)


def tiled_average(short: Column, long: Column) -> Column:
    """Mean of ``long`` and of ``short`` repeated to its length."""
    n = F.size(short)
    return F.transform(long, lambda y, i: (F.element_at(short, (i % n + 1).cast("int")) + y) / 2)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def frames(a: Column, width: int) -> Column:
    """Non-overlapping frames; the last one is filled with zeros."""
    n = F.ceil(F.size(a) / width).cast("int")
    filled = F.concat(a, F.array_repeat(F.lit(0.0), n * width - F.size(a)))
    cut = let(filled, lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(w, i * width + 1, F.lit(width))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<double>>"))


def activity(a: Column, width: int, threshold_db: float = -36.0) -> Column:
    """1 for each frame whose level after peak normalisation reaches the threshold, else 0."""
    if width <= 0:
        raise ValueError("the window must hold a sample")
    unit = let(peak(a), lambda p: F.when(p > 0, F.transform(a, lambda x: x / p)).otherwise(a))
    rms = lambda f: F.sqrt(F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x * x) / width)
    return F.transform(frames(unit, width), lambda f: (20 * F.log10(rms(f) + FLOOR) >= threshold_db).cast("int"))
