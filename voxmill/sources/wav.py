"""Audio files: WAV and FLAC without further libraries; other formats through a plug-in."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxmill.functions.arrays import nested, pcm, signals
from voxmill.sources import files, flac

#: Decoders by extension: bytes -> ((channels, samples), rate). Install others with ``register``.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {}
#: Readers of a file's first bytes by extension: bytes -> (rate, channels, samples).
HEADERS: dict[str, Callable[[bytes], tuple[int, int, int]]] = {}
HEAD_BYTES = 1 << 16

AUDIO = "path string, sr int, n_channels int, n_samples long, duration double, channels array<array<double>>, error string"


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = ((b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, n).T, rate


def wav_header(data: bytes) -> tuple[int, int, int]:
    """(rate, channels, samples) from the chunks before the samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little"), int.from_bytes(data[at + 20 : at + 22], "little")
        elif kind == b"data" and form:
            return form[1], form[0], size // form[2]
        at += 8 + size + size % 2
    raise ValueError("no samples found in the header")


def encode_wav(channels: np.ndarray, rate: int) -> bytes:
    """16-bit; values beyond full scale are clamped."""
    x = np.atleast_2d(np.asarray(channels))
    x = x if x.dtype == np.int16 else pcm(x)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.T.astype("<i2").tobytes())
    return out.getvalue()


DECODERS["wav"], HEADERS["wav"] = decode_wav, wav_header
DECODERS["flac"] = flac.decode
HEADERS["flac"] = lambda data: (lambda rate, n, _, total, __: (rate, n, total))(*flac.info(data))
ENCODERS = {"wav": encode_wav, "flac": flac.encode}


def register(extension: str, decoder: Callable[[bytes], tuple[np.ndarray, int]]) -> None:
    DECODERS[extension.lower()] = decoder


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def read_audio(spark: SparkSession, path: str, glob: str = "*.{wav,flac}", samples: bool = True) -> DataFrame:
    """One row per file, found recursively; a file that can't be decoded gives a row with its ``error``.

    Without ``samples`` only rate, length and duration come out, from the first bytes of each file.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    decoders, headers = dict(DECODERS), dict(HEADERS)

    def row(path: str, data: bytes | None):
        try:
            kind = _extension(path)
            if data is None and kind in headers:
                rate, n, length = headers[kind](files.head(path, HEAD_BYTES))
                if length or kind != "flac":  # a stream of unknown length says 0
                    return path, rate, n, length, length / rate, None, None
            x, rate = decoders[kind](bytes(data) if data is not None else files.head(path, None))
            return path, rate, x.shape[0], x.shape[1], x.shape[1] / rate, x if data is not None else None, None
        except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
            return path, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            data = b.column("content") if samples else [None] * b.num_rows
            for p, d in zip(b.column("path"), data):  # a file at a time, since each may be long
                r = row(p.as_py(), d.as_py() if samples else None)
                cols = [pa.array([v], t) for v, t in zip(r[:5], (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*cols, nested([r[5]]), pa.array([r[6]], pa.string())], NAMES)

    def headers_only(batches):
        for b in batches:
            rows = [row(p, None) for p in b["path"]]
            yield pd.DataFrame(rows, columns=NAMES).astype({"sr": "Int32", "n_channels": "Int32", "n_samples": "Int64"})

    return found.select("path", "content").mapInArrow(run, AUDIO) if samples else found.select("path").mapInPandas(headers_only, AUDIO)


NAMES = ["path", "sr", "n_channels", "n_samples", "duration", "channels", "error"]


def write_audio(df: DataFrame, root: str) -> DataFrame:
    """Write (name, sr, channels) rows as files below ``root``, in the format of the name's extension; returns (path, n_bytes)."""
    def run(batches):
        for b in batches:
            for n, sr, x in zip(b.column("name").to_pylist(), b.column("sr").to_pylist(), signals(b.column("channels"))):
                data = ENCODERS[_extension(n)](x, int(sr))
                files.put(f"{root}/{n}", data)
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{n}"]), pa.array([len(data)], pa.int64())], ["path", "n_bytes"])

    return df.select("name", "sr", "channels").mapInArrow(run, "path string, n_bytes long")
