"""Corpus catalogues: duration filters and the lookups of transcripts and turns by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import base_name, stripped, word_count


def in_range(df: DataFrame, duration: str, least: float, most: float) -> DataFrame:
    """Inclusive on both ends; null and NaN durations are out."""
    return df.filter(F.col(duration).between(least, most) & ~F.isnan(duration))


def first_microphone(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(base_name(F.col(path)).endswith("_mic1.flac"))


def with_transcript(audio: DataFrame, text: DataFrame, turns: DataFrame | None, on: list[str]) -> DataFrame:
    """Audio rows that have a text (inner), stripped, with their turns where there are any (left)."""
    out = audio.join(text.withColumn("text", stripped(F.col("text"))), on)
    return out if turns is None else out.join(turns, on, "left")


def with_audio(text: DataFrame, audio: DataFrame, on: list[str]) -> DataFrame:
    return text.join(audio.select(*on), on, "left_semi")


def without_audio(text: DataFrame, audio: DataFrame, on: list[str]) -> DataFrame:
    return text.join(audio.select(*on), on, "left_anti")


def speaker_pool(audio: DataFrame, most: float = 20.0) -> DataFrame:
    """Rows of at most ``most`` seconds with their raw word count."""
    return audio.filter((F.col("duration") <= most) & ~F.isnan("duration")).withColumn("n_words", word_count(F.col("text")))


def first_m_of_first_n(df: DataFrame, group: str, order: list[str], n: int, m: int) -> DataFrame:
    """First ``m`` rows of each of the first ``n`` groups in sorted order; a feature of the audit, not a sample."""
    from pyspark.sql import Window

    groups = df.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(group).limit(n)
    kept = df.join(F.broadcast(groups), group)  # at most n rows
    w = Window.partitionBy(group).orderBy(*order)
    return kept.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= m)
