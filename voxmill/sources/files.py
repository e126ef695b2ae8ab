"""Single files in the folders that all executors share, whatever file system these are on."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _at(path: str):
    """(file system, path in it) of a plain path or of a URI such as ``hdfs://host/x`` or ``s3://bucket/x``."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def head(path: str, n: int | None) -> bytes:
    """The first ``n`` bytes of a file, or all of a shorter one or without ``n``."""
    system, at = _at(path)
    with system.open_input_file(at) as f:
        return f.read(n)


def put(path: str, data: bytes) -> None:
    """Write a whole file; a name never shows half of it, and a retried task writes the same bytes again."""
    import os
    import uuid

    system, at = _at(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{at}.{os.getpid()}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


def write_files(rows: DataFrame, root: str, encode: Callable[[dict], bytes]) -> DataFrame:
    """One file below ``root`` per row, named by its ``name``: (path, n_bytes). ``encode`` turns a row into bytes."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                data = encode(r)
                put(f"{root}/{r['name']}", data)
                out.append((f"{root}/{r['name']}", len(data)))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return rows.mapInPandas(run, "path string, n_bytes long")


def write_texts(df: DataFrame, root: str) -> DataFrame:
    """(name, text) rows as UTF-8 files; a null text is an empty file."""
    return write_files(df.select("name", "text"), root, lambda r: (r["text"] or "").encode())


def write_csvs(df: DataFrame, root: str, rows: str, columns: list[str]) -> DataFrame:
    """(name, ``rows``) as a CSV file per name with a header; ``rows`` is an array of structs."""
    def encode(r: dict) -> bytes:
        import csv
        import io

        out = io.StringIO(newline="")
        w = csv.writer(out)
        w.writerow(columns)
        w.writerows([x[c] for c in columns] for x in (r[rows] if r[rows] is not None else ()))
        return out.getvalue().encode()

    return write_files(df.select("name", rows), root, encode)


def copy_tree(spark: SparkSession, source: str, target: str, but: list[str]) -> int:
    """Copy the files below ``source`` whose path in it does not start with one of ``but``; returns their number.

    The listing holds names only; the bytes of a file go through one task.
    """
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path")
    base = source.rstrip("/")
    base = base if "://" in base else "file:" + base
    name = F.expr(f"substring(path, length('{base}') + 2)") if "://" in base else F.substring_index("path", base.removeprefix("file:") + "/", -1)
    kept = files.withColumn("name", name)
    for b in but:
        kept = kept.filter(~F.col("name").startswith(b.rstrip("/") + "/"))

    def run(batches):
        for b in batches:
            for p, n in zip(b["path"], b["name"]):
                system, at = _at(p)
                with system.open_input_stream(at) as f:
                    put(f"{target}/{n}", f.read())
            yield pd.DataFrame({"name": b["name"]})

    return kept.mapInPandas(run, "name string").count()
