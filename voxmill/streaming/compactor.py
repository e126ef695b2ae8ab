"""Consolidation of many small stored files into few well-sized ones."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.functions.paths import canonical_path
from voxmill.runtime import Workspace, broadcast_if_small, delete, exists, is_file

#: Size of an output file, and of the input files taken into one batch. A batch holds its keys against those of all
#: earlier ones, whose fingerprints are a thousandth of the data, so batches should be large.
TARGET_FILE_BYTES = 128 << 20
BYTES_PER_BATCH = 64 << 30


@dataclass
class Compacted:
    """``records``: every stored recording once; ``members``: every listing row and the recording it means."""

    records: DataFrame
    members: DataFrame


def file_key(flac: str = "flac_path", txt: str = "txt_path", root: str = "/srv/speech"):
    """Identity of a listing row: its audio path, or its text path where there is no audio path; else null."""
    audio, text = canonical_path(F.col(flac), root), canonical_path(F.col(txt), root)
    return F.coalesce(F.concat(F.lit("a:"), audio), F.concat(F.lit("t:"), text))


def compact(
    spark: SparkSession,
    source: str,
    out: str,
    id_col: str = "file_id",
    root: str = "/srv/speech",
    target_bytes: int = TARGET_FILE_BYTES,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> Compacted:
    """Stream the listing at ``source`` into ``out`` until all that is there has been processed.

    The stream's checkpoint lists each input file once. Every micro-batch takes about
    ``bytes_per_batch`` of input files, however many they are, and writes under its batch
    number with overwrite, so a retried batch replaces its own output and nothing else. A
    recording that an earlier batch has stored is not stored again, unless it was stored without
    content and a row of this batch has it: that row is stored, and its key is noted under
    ``replaced``, so that ``records`` leaves out the earlier row. Within a batch the row with
    content and the smallest id wins. Rows without any path can't be matched with others: each is
    a recording of its own. Calling again after new files arrived continues from the checkpoint;
    a batch takes over the records of earlier batches that do not even fill half a file, so small
    arrivals do not leave small files. What was taken over is deleted by the batch after it, when
    no retry can need it any more.

    Nulls: null sizes count as zero; null content is kept. An empty listing gives empty tables.
    Extra columns are carried along; a column that is named like one of this operator's own
    (``file_key``, ``batch``, ``stored_bytes``) is renamed with a trailing ``_in``.
    """
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    if is_file(spark, source):
        folder, _, name = source.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(source)
    own = {"file_key", "batch", "stored_bytes"}
    for c in schema.names:
        if c in own:
            stream = stream.withColumnRenamed(c, f"{c}_in")
    lone = F.concat(F.lit("r:"), F.coalesce(F.col(id_col).cast("string"), F.uuid()))
    keyed = stream.withColumn("file_key", F.coalesce(file_key(root=root), lone))
    has_content = "content" in schema.names
    size = F.greatest(F.octet_length("content"), F.lit(0)) if has_content else F.lit(0)
    keyed = keyed.withColumn("stored_bytes", (F.coalesce(size, F.lit(0)) + F.lit(64)).cast("long"))
    filled = F.col("content").isNotNull() if has_content else F.lit(True)
    # The row with content and the smallest id wins; null ids are last.
    best = F.min(F.struct((~filled).alias("empty"), F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), "_row", "stored_bytes"))
    store = _Store(spark, out, keyed.schema, id_col)

    def write(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        batch = batch.withColumn("_row", F.monotonically_increasing_id()).persist()
        try:
            batch.select(id_col, "file_key").write.mode("overwrite").parquet(f"{out}/members/batch={number}")
            fresh = batch.groupBy("file_key").agg(best.alias("b")).select(*_fingerprint(), "file_key", (~F.col("b.empty")).alias("filled"), "b.stored_bytes", F.col("b._row").alias("row"))
            earlier, absorbed, again = [], [], F.lit(None).cast("string")
            if number > 0:
                store.clear(number)
                known = store.keys(number).groupBy(*_PRINTS).agg(F.max("filled").alias("_filled"))  # a key is stored twice at most
                fresh = fresh.join(known, _PRINTS, "left").filter(F.col("_filled").isNull() | (F.col("filled") & ~F.col("_filled")))
                again = F.when(F.col("_filled").isNotNull(), F.col("file_key"))
            fresh.select(*_PRINTS, "filled", "stored_bytes", "row", again.alias("again")).write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
            chosen = store.keys(number + 1).filter(F.col("batch") == number)
            n, total = (int(x or 0) for x in chosen.agg(F.count("*"), F.sum("stored_bytes")).first())
            if number > 0:
                chosen.filter("again is not null").select(F.col("again").alias("file_key")).write.mode("overwrite").parquet(f"{out}/replaced/batch={number}")
                absorbed = sorted(k for k, size in store.live(number).items() if size < target_bytes // 2)
                if absorbed:
                    earlier = [store.records(number, absorbed).join(store.replaced(number + 1, number), "file_key", "left_anti")]
                    total += int(earlier[0].agg(F.sum("stored_bytes")).first()[0] or 0)
            rows = broadcast_if_small(chosen.select(F.col("row").alias("_row")), n, 16)
            laid = reduce(DataFrame.unionByName, [batch.join(rows, "_row", "left_semi").select(columns), *[e.select(columns) for e in earlier]])
            parts = max(1, -(-total // target_bytes))
            # A range layout keeps neighbouring recordings in one file and splits a hot folder.
            laid = laid.repartitionByRange(parts, "file_key") if parts > 1 else laid.repartition(1)
            laid.sortWithinPartitions("file_key", id_col).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
            spark.createDataFrame([(total, absorbed)], "stored_bytes long, absorbed array<int>").coalesce(1).write.mode("overwrite").parquet(f"{out}/sizes/batch={number}")
        finally:
            batch.unpersist()

    query = keyed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return Compacted(store.records(), store.read("members", f"{id_col} {dict(keyed.dtypes)[id_col]}, file_key string"))


_PRINTS = ["k1", "k2"]


def _fingerprint() -> list[Column]:
    """128 bits that stand for a key where all earlier ones are looked up."""
    return [F.xxhash64("file_key").alias("k1"), F.xxhash64(F.lit(1), F.reverse("file_key")).alias("k2")]


class _Store:
    """The tables of a compacted folder, as of the batches below ``number``."""

    def __init__(self, spark: SparkSession, out: str, schema: T.StructType, id_col: str):
        self.spark, self.out, self.schema, self.id_col = spark, out, schema, id_col

    def read(self, table: str, schema: str | T.StructType, number: int | None = None) -> DataFrame:
        schema = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField("batch", T.IntegerType())])
        at = f"{self.out}/{table}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", at).parquet(at)
        return df if number is None else df.filter(F.col("batch") < number)

    def keys(self, number: int) -> DataFrame:
        return self.read("keys", "k1 long, k2 long, filled boolean, stored_bytes long, row long, again string", number)

    def replaced(self, number: int | None = None, at_least: int = 0) -> DataFrame:
        return self.read("replaced", "file_key string", number).filter(F.col("batch") >= at_least).withColumnRenamed("batch", "_by")

    def _sizes(self, number: int | None) -> tuple[dict[int, int], dict[int, int]]:
        """Bytes of each batch, and by which later one it was taken over."""
        rows = self.read("sizes", "stored_bytes long, absorbed array<int>", number).collect()  # one row per batch
        return {r["batch"]: r["stored_bytes"] for r in rows}, {n: r["batch"] for r in rows for n in r["absorbed"]}

    def live(self, number: int | None = None) -> dict[int, int]:
        sizes, absorbed = self._sizes(number)
        return {n: size for n, size in sizes.items() if n not in absorbed}

    def records(self, number: int | None = None, only: list[int] | None = None) -> DataFrame:
        live = only if only is not None else sorted(self.live(number))
        records = self.read("records", self.schema).filter(F.col("batch").isin(live))
        replaced = self.replaced(number)
        if replaced.head(1):
            # A key is replaced at most once, by the first later row that has content.
            records = records.join(replaced, "file_key", "left").filter(F.col("_by").isNull() | (F.col("batch") >= F.col("_by"))).select(records.columns)
        return records

    def clear(self, number: int) -> None:
        """Delete what batches before the one before ``number`` took over; ``number`` would not run if they could be retried."""
        for n, by in self._sizes(number)[1].items():
            if by < number and exists(self.spark, f"{self.out}/records/batch={n}"):
                delete(self.spark, f"{self.out}/records/batch={n}")


def classes(members: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One row per stored recording: its key, the first of its listing rows and their number."""
    return members.groupBy("file_key").agg(F.min(id_col).alias(f"first_{id_col}"), F.count("*").alias("n_listed"))


def same_file_pairs(members: DataFrame, id_col: str = "file_id") -> DataFrame:
    """All pairs of listing rows that mean one file, smaller id first; rows without a path pair with nothing.

    Keys with a single row are dropped by a partial aggregation before the self join, so only
    repeated listings are shuffled twice. The join is by key and id order, not a cross join; its
    size is that of the result the caller asks for.
    """
    m = members.filter(~F.col("file_key").startswith("r:")).select("file_key", id_col)
    repeated = m.groupBy("file_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("file_key")
    m = m.join(repeated, "file_key", "left_semi")
    a, b = m.withColumnRenamed(id_col, f"{id_col}_a"), m.withColumnRenamed(id_col, f"{id_col}_b")
    return a.join(b, "file_key").filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Workspace(spark, "compact").root
    return same_file_pairs(compact(spark, f"{sf_dir}/speech_files.parquet", at).members)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored recording with its listing rows and the fingerprint of its content."""
    c = compact(spark, f"{sf_dir}/speech_files.parquet", Workspace(spark, "compact").root)
    stored = c.records.select("file_key", "file_id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))
    return classes(c.members).join(stored, "file_key").drop("file_key")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per output batch: recordings, listing rows and bytes, to be held against the input."""
    c = compact(spark, f"{sf_dir}/speech_files.parquet", Workspace(spark, "compact").root)
    stored = c.records.groupBy("batch").agg(F.count("*").alias("n_records"), F.sum("stored_bytes").alias("n_stored_bytes"))
    listed = c.members.groupBy("batch").agg(F.count("*").alias("n_listed"))
    return listed.join(stored, "batch", "left")
