"""Scenes: the grid of conditions, clip offsets, and rendering of segments into all conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event-to-background and speech-to-ambience ratios in dB, and target levels.
EBRS = {"low": -50.0, "mid": 3.0, "high": 12.0}
SARS = {"low": 20.0, "mid": 10.0, "high": 0.0}
SPEECH_LEVEL, CLIP_LEVEL, ITEM_LEVEL = -136.93, -131.37, -130.0


def grid(spark: SparkSession) -> DataFrame:
    """The ten conditions: all pairs of levels, and none with none."""
    ebr = spark.createDataFrame([(k, v) for k, v in EBRS.items()] + [("none", None)], "ebr string, ebr_db double")
    sar = spark.createDataFrame([(k, v) for k, v in SARS.items()] + [("none", None)], "sar string, sar_db double")
    return ebr.crossJoin(sar).filter((F.col("ebr") == "none") == (F.col("sar") == "none"))


def with_conditions(segments: DataFrame) -> DataFrame:
    """Every segment in every condition (ten rows each)."""
    return segments.crossJoin(F.broadcast(grid(segments.sparkSession)))


def offset(seed: int, key: list[Column], clip: str, most: Column) -> Column:
    """A start below ``most`` that depends on the seed and the key only, so retries and partitioning don't change it."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *key, F.lit(clip)))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), most)


RENDERED = T.StructType(
    [
        T.StructField("stem", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("ebr", T.StringType()),
        T.StructField("sar", T.StringType()),
        T.StructField("pan", T.DoubleType()),
        T.StructField("sr", T.IntegerType()),
        T.StructField("channels", T.ArrayType(T.ArrayType(T.ShortType()))),
    ]
)


def render(segments: DataFrame, events, background, sr: int, segment_s: float, pan: float = 0.0, seed: int = 0) -> DataFrame:
    """Ten rows per segment (stem, speaker_id, samples): room, level, and mix with cuts of the two source clips.

    ``events`` and ``background`` are (2, n) arrays at ``sr``; both travel once to each executor. The
    room convolution and the level of a segment are computed once, not per condition. Samples come
    out as 16-bit integers, one condition at a time, so a task holds a few copies of one segment. A clip not
    longer than the segment is refused. Null or empty sample arrays give no rows.
    """
    import numpy as np

    n = int(segment_s * sr)
    clips = {"events": np.asarray(events, float), "background": np.asarray(background, float)}
    for name, c in clips.items():
        if c.ndim != 2 or c.shape[0] != 2:
            raise ValueError(f"the {name} clip must have two channels")
        if c.shape[1] <= n:
            raise ValueError(f"the {name} clip must be longer than a segment")
    shared = segments.sparkSession.sparkContext.broadcast(clips)

    def run(batches):
        import pyarrow as pa

        from voxmill.functions.arrays import nested, pcm

        for b in batches:
            for stem, who, samples in zip(b.column("stem").to_pylist(), b.column("speaker_id").to_pylist(), b.column("samples")):
                if not samples.is_valid or not len(samples):
                    continue
                for ebr, sar, y in renderings(samples.values.to_numpy(zero_copy_only=False), stem, shared.value, sr, n, pan, seed):
                    row = [pa.array([v], t) for v, t in zip((stem, who, ebr, sar, pan, sr), (pa.string(),) * 4 + (pa.float64(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*row, nested([pcm(y)], "int16")], RENDERED.names)

    return segments.select("stem", "speaker_id", "samples").mapInArrow(run, RENDERED)


def renderings(x, stem: str, clips: dict, sr: int, n: int, pan: float, seed: int):
    """(ebr, sar, (2, n) samples) of a segment in each condition, the clean one first."""
    import hashlib

    import numpy as np

    from voxmill.functions import kernels

    def start(ebr: str, sar: str, clip: str, most: int) -> int:
        return int(hashlib.md5("|".join([str(seed), stem, ebr, sar, clip]).encode()).hexdigest()[:12], 16) % most

    wet = kernels.in_room(x / (np.abs(x).max() + 1e-9), sr, pan)
    wet = wet[:, :n] if wet.shape[1] > n else np.pad(wet, ((0, 0), ((n - wet.shape[1]) // 2, n - wet.shape[1] - (n - wet.shape[1]) // 2)))
    wet = wet * 10 ** ((SPEECH_LEVEL - kernels.level_db(wet, sr)) / 20)
    yield "none", "none", wet
    for e, e_db in EBRS.items():
        for s, s_db in SARS.items():
            cut = {k: c[:, (o := start(e, s, k, c.shape[1] - n)) : o + n] for k, c in clips.items()}
            yield e, s, kernels.mix_scene(wet, cut["events"], cut["background"], sr, e_db, s_db)


def office_level(keyboard, office, sr: int) -> tuple[float, "object"]:
    """(level, mix) of two stereo clips, the first repeated to the length of the second and averaged with it."""
    import numpy as np

    from voxmill.functions import kernels

    k, o = np.asarray(keyboard, float), np.asarray(office, float)
    if k.ndim != 2 or o.ndim != 2:
        raise ValueError("both clips must have two channels")
    reps = -(-o.shape[1] // k.shape[1])
    y = (np.tile(k, reps)[:, : o.shape[1]] + o) / 2
    return kernels.level_db(y, sr), y
