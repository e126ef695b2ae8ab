"""Audit of a rendered dataset: completeness, shapes, and recovered level ratios."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions import signal as S
from voxmill.operators.scene import EBRS, SARS, grid

# Tolerances in dB, and what makes a recovered event ratio trustworthy.
SAR_TOLERANCE, EBR_TOLERANCE, LEAST_CONFIDENCE, LEAST_R2, LEAST_GAIN = 0.5, 1.0, 3.0, 0.9, 1e-4
#: Directory names of the two path layouts.
LAYOUTS = {"current": "ebr-{ebr}-sar-{sar}/pan_0", "old": "ebr-{ebr}-asr-{sar}/evaluation/pan_0"}


def condition_path(clean: Column, ebr: Column, sar: Column, layout: str = "current") -> Column:
    """Path of a condition's file from the path of the clean one: every occurrence of the condition's name is replaced."""
    name = LAYOUTS[layout].split("/")[0]
    none = name.format(ebr="none", sar="none")
    parts = name.replace("{ebr}", "\0{ebr}\0").replace("{sar}", "\0{sar}\0").split("\0")
    given = {"{ebr}": ebr, "{sar}": sar}
    return F.replace(clean, F.lit(none), F.concat(*[given[p] if p in given else F.lit(p) for p in parts if p]))


def checks(mixed: DataFrame, key: str = "stem") -> DataFrame:
    """Nine rows per clean segment: key, ebr, sar, sar_db, status, sr, and the ids of the two deliveries compared.

    Deliveries of one (segment, condition) count once, the smallest id. ``status`` is MISSING,
    MISMATCH (other rate, channel count or length) or CHECKED. Rows of a null segment or condition
    are left out. Only lengths are compared here; ``with_audio`` adds the signals to what has to be measured.
    """
    size = lambda c: F.coalesce(F.size(F.get("channels", F.lit(c))), F.lit(-1))
    shape = F.struct("sr", F.size("channels").alias("n"), size(0).alias("n0"), size(1).alias("n1"), F.col("mixed_id").alias("id"))
    rows = mixed.filter(F.col(key).isNotNull()).select(key, "ebr", "sar", "mixed_id", shape.alias("s")).groupBy(key, "ebr", "sar").agg(F.min_by("s", "mixed_id").alias("a"))
    clean = rows.filter("ebr = 'none' and sar = 'none'").select(key, F.col("a").alias("clean"))
    wanted = F.broadcast(grid(mixed.sparkSession).filter("ebr <> 'none'"))
    out = clean.crossJoin(wanted).join(rows.withColumnRenamed("a", "noisy"), [key, "ebr", "sar"], "left")
    same = F.lit(True)
    for f in ("sr", "n", "n0", "n1"):
        same &= F.col(f"clean.{f}") == F.col(f"noisy.{f}")
    status = F.when(F.col("noisy").isNull(), "MISSING").when(same, "CHECKED").otherwise("MISMATCH")
    return out.select(key, "ebr", "sar", "sar_db", status.alias("status"), F.col("clean.sr").alias("sr"), F.col("clean.id").alias("clean_id"), F.col("noisy.id").alias("noisy_id"))


def with_audio(checked: DataFrame, mixed: DataFrame) -> DataFrame:
    """The checked rows with both signals (``clean``, ``noisy``), joined by the deliveries' unique ids."""
    c = checked.filter("status = 'CHECKED'")
    by = lambda n: mixed.select(F.col("mixed_id").alias(f"{n}_id"), F.col("channels").alias(n))
    return c.join(by("clean"), "clean_id").join(by("noisy"), "noisy_id")


def sar_levels(audible: DataFrame, fs: int, key: str = "stem") -> DataFrame:
    """Recovered speech-to-ambience ratio of the rows at rate ``fs`` by column expressions, for signals of a few samples."""
    c = audible.filter(F.col("sr") == fs)
    speech = S.mono(F.col("clean"))
    ambience = S.minus(S.mono(F.col("noisy")), speech)
    m = c.withColumn("measured_sar", S.level_db(speech, fs) - S.level_db(ambience, fs))
    diff = F.col("measured_sar") - F.col("sar_db")
    return m.select(key, "ebr", "sar", F.round("measured_sar", 6).alias("measured_sar"), F.round(diff, 6).alias("diff"), (F.abs(diff) <= SAR_TOLERANCE).alias("sar_pass"))


def all_sar_levels(mixed: DataFrame, key: str = "stem") -> DataFrame:
    """Recovered ratios of all checked rows, whatever their rates; nothing can be measured at a rate that is not positive."""
    c = checks(mixed, key)
    rates = sorted(r["sr"] for r in mixed.select("sr").filter("sr is not null").distinct().collect())  # one row per rate
    none = c.filter("status = 'CHECKED' and sr <= 0").select(key, "ebr", "sar", *[F.lit(None).cast(t).alias(n) for n, t in (("measured_sar", "double"), ("diff", "double"), ("sar_pass", "boolean"))])
    c = with_audio(c, mixed)
    return reduce(DataFrame.unionByName, [sar_levels(c, fs, key) for fs in rates if fs > 0], none)


LONG = "stem string, ebr string, sar string, measured_sar double, sar_diff double, sar_pass boolean, measured_ebr double, ebr_pass boolean, conf_events double, conf_bg double, fit_r2 double, incremental_r2 double"


def long_checks(audible: DataFrame, events=None, background=None) -> DataFrame:
    """Both ratios of long signals: one row per row of ``with_audio``, numpy kernels on one pair at a time.

    With the source clips (2, n) given, they are located in the recovered ambience, and both gains
    are fitted; ``ebr_pass`` is null where the fit cannot be trusted.
    """
    import numpy as np

    clips = None if events is None or background is None else (np.asarray(events, float), np.asarray(background, float))
    shared = audible.sparkSession.sparkContext.broadcast(clips)

    def run(batches):
        from voxmill.functions.arrays import signals

        for b in batches:
            names = [b.column(c).to_pylist() for c in ("stem", "ebr", "sar", "sr")]
            for stem, ebr, sar, sr, x, y in zip(*names, signals(b.column("clean")), signals(b.column("noisy"))):
                row = [stem, ebr, sar, *_ratios(x, y, ebr, sar, sr, shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, LONG_TYPES)], [f.split(" ")[0] for f in LONG.split(", ")])

    return audible.select("stem", "ebr", "sar", "sr", "clean", "noisy").mapInArrow(run, LONG)


LONG_TYPES = [{"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[f.split(" ")[1]] for f in LONG.split(", ")]


def _ratios(x, y, ebr: str, sar: str, sr: int, clips) -> list:
    from voxmill.functions import kernels

    amb = y - x
    measured = kernels.level_db(x, sr) - kernels.level_db(amb, sr)
    out = [measured, measured - SARS[sar], bool(abs(measured - SARS[sar]) <= SAR_TOLERANCE)] + [None] * 6
    if clips is not None:
        ev, bg = clips
        (oe, ce), (ob, cb) = kernels.locate(amb.mean(axis=0), ev.mean(axis=0)), kernels.locate(amb.mean(axis=0), bg.mean(axis=0))
        if oe is not None and ob is not None:
            es, bs = ev[:, oe : oe + amb.shape[1]], bg[:, ob : ob + amb.shape[1]]
            a, bb, r2, gain = kernels.fit_two(amb, es, bs)
            e = kernels.level_db(a * es, sr) - kernels.level_db(bb * bs, sr)
            sure = ce > LEAST_CONFIDENCE and cb > LEAST_CONFIDENCE and r2 > LEAST_R2 and gain > LEAST_GAIN
            out[3:] = [e, bool(abs(e - EBRS[ebr]) <= EBR_TOLERANCE) if sure else None, ce, cb, r2, gain]
    return [v if v is None or isinstance(v, bool) else float(v) for v in out]


def totals(results: DataFrame) -> DataFrame:
    """(n_checked, n_failed): missing and mismatched rows fail once, each failed ratio once; null passes don't count."""
    cols = set(results.columns)
    failed = F.sum((F.col("status") != "CHECKED").cast("long"))
    for c in ("sar_pass", "ebr_pass"):
        if c in cols:
            failed = failed + F.coalesce(F.sum((~F.col(c)).cast("long")), F.lit(0))
    return results.agg(F.count("*").alias("n_checked"), F.coalesce(failed, F.lit(0)).alias("n_failed"))
