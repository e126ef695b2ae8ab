"""Manifests in JSON lines and call transcripts in CHAT format."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.text import stripped


def read_manifests(spark: SparkSession, paths: list[str], root: str, least: float, most: float) -> DataFrame:
    """Rows of JSON-lines manifests within the duration range, with speaker_id and the rooted path.

    Durations may be numbers or strings; blank lines and lines that are no JSON objects give no row.
    The speaker is the first ``_`` field of the second path step, taken before the root is put in front.
    All other keys stay in ``extra`` as JSON text.
    """
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    d = F.try_variant_get(F.try_parse_json("value"), "$.duration", "string").try_cast("double")
    p = F.get_json_object("value", "$.audio_filepath")
    rows = lines.select(p.alias("p"), d.alias("duration"), F.col("value").alias("extra")).filter(F.col("p").isNotNull() & F.col("duration").between(least, most))
    speaker = F.split_part(F.split_part("p", F.lit("/"), F.lit(2)), F.lit("_"), F.lit(1))
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), "p").alias("audio_filepath"), "duration", speaker.alias("speaker_id"), "extra")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): whole files, stripped."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return t.select(F.input_file_name().alias("path"), stripped(F.col("value")).alias("text"))


def parse_chat(text: str) -> list[tuple[str, list[str]]]:
    """(participant, tokens) of the main lines; a line that starts with a tab continues the one before."""
    out: list[list] = []
    main = False
    for line in text.splitlines():
        if m := re.match(r"\*([^:\s]+):\s*(.*)", line):
            out.append([m[1], m[2]])
            main = True
        elif line.startswith("\t") and main:
            out[-1][1] += " " + line.strip()
        else:
            main = False
    return [(p, t.split()) for p, t in out]


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, participant, tokens) of all ``.cha`` files below ``path``; an unreadable file gives no rows."""
    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    rows += [(p.rsplit("/", 1)[-1], i, who, toks) for i, (who, toks) in enumerate(parse_chat(bytes(data).decode("utf-8")))]
                except UnicodeDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=["file", "idx", "participant", "tokens"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cha").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, idx int, participant string, tokens array<string>")
