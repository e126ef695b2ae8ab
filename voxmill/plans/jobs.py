"""The command line's jobs. A corpus is a folder with ``wav48_silence_trimmed/<speaker>/*_mic1`` audio files
(FLAC or WAV), ``txt/<speaker>/*.txt`` and, for conversations, ``turns/<speaker>/*.csv``; the jobs write the
same layout, so each reads what another wrote. Folders must be visible to all executors. Catalogues come from
the files' first bytes; only the task that builds a segment opens its audio files, so audio is never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import text as X
from voxmill.functions.arrays import as_signal, nested, pcm, signals
from voxmill.operators import audit, conversations, matching, packing, scene, stats
from voxmill.operators.ordering import sorted_rank
from voxmill.runtime import Workspace, exists
from voxmill.sources import files, text_files, wav

AUDIO_DIR, TEXT_DIR, TURNS_DIR, FADE_S, GAP_S = "wav48_silence_trimmed", "txt", "turns", 0.01, 0.1
FORMAT, INFO_FILES = "flac", ("speaker-info.txt", "update.txt")
TURN = ["speaker", "text", "timestamp", "original_filename"]
TURNS = "array<struct<speaker:string,text:string,timestamp:string,original_filename:string>>"
ASSEMBLED = f"name string, sr int, channels array<array<smallint>>, transcript string, turns {TURNS}"


def _key(name: Column) -> Column:
    """``speaker_utterance`` of a file's or segment's name, whatever its folder, microphone and extension."""
    base = X.stem(name)
    return F.concat_ws("_", X.speaker_of(base), X.utterance_of(base))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """(key, text) of a corpus."""
    if not exists(spark, f"{root}/{TEXT_DIR}"):
        raise FileNotFoundError(f"no transcripts below {root}")
    return text_files.read_texts(spark, f"{root}/{TEXT_DIR}").select(X.stem(F.col("path")).alias("key"), "text")


def _turns(spark: SparkSession, root: str) -> DataFrame | None:
    """(key, turns) of a corpus, or None without any."""
    at = f"{root}/{TURNS_DIR}"
    if not exists(spark, at):
        return None
    csv = spark.read.options(header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter="*.csv").schema(", ".join(f"{c} string" for c in TURN)).csv(at)
    # The turns of one file are one record; a file is at most a minute long.
    line = F.struct(F.col("timestamp").try_cast("double").alias("at"), *TURN)
    rows = csv.groupBy(X.stem(F.input_file_name()).alias("key")).agg(F.sort_array(F.collect_list(line)).alias("turns"))
    return rows.select("key", F.transform("turns", lambda t: F.struct(*[t[c].alias(c) for c in TURN])).alias("turns"))


def _catalogue(spark: SparkSession, root: str, glob: str = "*_mic1.{wav,flac}") -> DataFrame:
    """(path, name, speaker, utt, sr, duration, text) of a corpus' audio files; text may be null."""
    a = wav.read_audio(spark, f"{root}/{AUDIO_DIR}", glob, samples=False).filter("error is null")
    name = X.base_name(F.col("path"))
    a = a.select("path", name.alias("name"), X.speaker_of(name).alias("speaker"), F.split_part(X.stem(name), F.lit("_"), F.lit(2)).alias("utt"), "sr", "duration")
    # Stored once, since the jobs read it several times and each reading would open every file.
    return Workspace(spark, "catalogue").save(a.join(_texts(spark, root), F.concat_ws("_", "speaker", "utt") == F.col("key"), "left").drop("key"), "catalogue")


def _opened(path: str) -> tuple[np.ndarray, int]:
    """Mono samples and rate of one file."""
    x, rate = wav.DECODERS[path.rsplit(".", 1)[-1].lower()](files.head(path, None))
    return x.mean(axis=0), rate


def _assemble(plan: DataFrame, catalogue: DataFrame, gap: float, pad_to: float | None, level: float | None, fade: float) -> DataFrame:
    """One row per segment of ``plan`` (segment, pos, file, speaker): its items' audio in order, with gaps and padding.

    A segment holds at most about a minute of audio, or one long item; that bounds the group. The
    group has names only: its task opens the files.
    """
    def build(table: pa.Table) -> pa.Table:
        from voxmill.functions import kernels

        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        parts, turns, at, sr = [], [], 0, None
        for r in rows:
            x, rate = _opened(r["path"])
            if sr not in (None, rate):
                raise ValueError(f"several sampling rates in {r['segment']}")
            sr = rate
            x = x if level is None else kernels.normalized(x, sr, level)
            n = min(int(sr * fade), len(x) // 2)
            if n > 0:
                x = x * np.r_[np.linspace(0, 1, n), np.ones(len(x) - 2 * n), np.linspace(1, 0, n)]
            if parts:
                parts.append(np.zeros(int(round(gap * sr))))
                at += len(parts[-1])
            turns.append((r["speaker"], r["text"] or "", at / sr, r["file"]))
            parts.append(x)
            at += len(x)
        y = np.concatenate(parts)
        left = max(0, int((pad_to or 0) * sr) - len(y)) // 2
        right = max(0, int((pad_to or 0) * sr) - len(y)) - left
        said = [{"speaker": w, "text": t, "timestamp": f"{s + left / sr:.3f}", "original_filename": f} for w, t, s, f in turns]
        text = " ".join(t.strip() for _, t, _, _ in turns if t.strip())
        kind = pa.list_(pa.struct([(c, pa.string()) for c in TURN]))
        cols = [pa.array([rows[0]["segment"]]), pa.array([sr], pa.int32()), nested([pcm(np.pad(y, (left, right)))], "int16"), pa.array([text]), pa.array([said], kind)]
        return pa.Table.from_arrays(cols, [f.split(" ")[0] for f in ("name", "sr", "channels", "transcript", "turns")])

    joined = plan.join(catalogue.select(F.col("name").alias("file"), "path", "text"), "file")
    return joined.select("segment", "pos", "file", "speaker", "path", "text").groupBy("segment").applyInArrow(build, ASSEMBLED)


def _write(out: DataFrame, root: str, turns: bool = False) -> None:
    """Audio files, transcripts and turns, a file each; the segments are computed once and the side files written from them."""
    ws = Workspace(out.sparkSession, "segments")
    kept = ws.save(out, "segments")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    speaker, key = F.split_part("name", F.lit("/"), F.lit(1)), _key(F.col("name"))
    at = lambda folder, ext: F.concat(F.lit(folder + "/"), speaker, F.lit("/"), key, F.lit(ext))
    done(wav.write_audio(kept.withColumn("name", F.concat(F.lit(f"{AUDIO_DIR}/"), "name", F.lit(f".{FORMAT}"))), root))
    done(files.write_texts(kept.select(at(TEXT_DIR, ".txt").alias("name"), F.col("transcript").alias("text")), root))
    if turns:
        done(files.write_csvs(kept.select(at(TURNS_DIR, ".csv").alias("name"), "turns"), root, "turns", TURN))
    ws.drop(kept)


def _copy_info(spark: SparkSession, source: str, target: str, names: tuple[str, ...] = INFO_FILES) -> None:
    """The corpus' small description files; a missing one is reported."""
    for name in names:
        if exists(spark, f"{source}/{name}"):
            files.put(f"{target}/{name}", files.head(f"{source}/{name}", None))
        else:
            print(f"{name} not found in {source}")


def _kept(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and stored first unless an earlier call finished it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def monospeaker_reformat(spark: SparkSession, input_vctk_dir: str, output_vctk_dir: str) -> None:
    """Long items stay as they are; short ones are packed, padded to a minute and named by their first and last."""
    _copy_info(spark, input_vctk_dir, output_vctk_dir)
    cat = _catalogue(spark, input_vctk_dir)
    packed = packing.pack(cat, "speaker", "name", "duration")
    b = packing.buffers(packed).filter("kept")
    utt = lambda c: X.utterance_of(F.col(c))
    named = b.select("speaker", "pool", "buf", F.concat_ws("/", "speaker", X.packed_name(F.col("speaker"), utt("first_item"), utt("last_item"), F.col("n_items"))).alias("segment"))
    plan = packed.join(named, ["speaker", "pool", "buf"]).select("segment", "pos", F.col("item").alias("file"), "speaker")
    short = _assemble(plan, cat, GAP_S, packing.CAP_S, scene.ITEM_LEVEL, 0.0)
    long_ = cat.filter(F.col("duration") >= packing.FLOOR_S)
    whole = long_.select(F.concat_ws("/", "speaker", X.stem(F.col("path"))).alias("segment"), F.lit(0).alias("pos"), F.col("name").alias("file"), "speaker")
    _write(short.unionByName(_assemble(whole, cat, 0.0, None, scene.ITEM_LEVEL, 0.0)), output_vctk_dir)


def multispeaker_lengths(spark: SparkSession, callhome_dir: str, vctk_dir: str, data_dir: str) -> None:
    """Turn lengths of the calls, the corpus' lengths, matched groups and their common histogram, as tables.

    Each of the first three is kept if an earlier call finished it.
    """
    def calls() -> DataFrame:
        chat = text_files.read_chat(spark, callhome_dir)
        if not chat.head(1):
            raise RuntimeError(f"no transcripts below {callhome_dir}")
        return stats.turn_runs(chat, "file", "participant", F.size(X.clean_transcript_tokens(F.col("tokens"))), ["idx"])

    words = F.size(X.clean_words(F.col("text")))
    turns = _kept(spark, f"{data_dir}/turns.parquet", calls)
    corpus = _kept(spark, f"{data_dir}/corpus.parquet", lambda: _catalogue(spark, vctk_dir).filter("text is not null").select("name", "speaker", words.alias("n_words")).filter("n_words > 0"))

    def matched() -> DataFrame:
        # One row per distinct length: their number is at most the root of twice the words.
        targets = {r["n_words"]: r["n"] for r in turns.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
        return matching.match(corpus, targets, "speaker", "name", "n_words")

    groups = _kept(spark, f"{data_dir}/groups.parquet", matched)
    lengths = groups.groupBy("speaker", "part", "group_no").agg(F.sum("length").alias("n")).select("n")
    stats.histograms({"calls": turns.select("n_words"), "corpus": corpus.select("n_words"), "matched": lengths}).write.mode("overwrite").parquet(f"{data_dir}/histogram.parquet")


def multispeaker_group(spark: SparkSession, groups_path: str, input_vctk_dir: str, output_vctk_dir: str) -> None:
    """Each group as one file: levelled items with faded edges and gaps between them; the corpus' other files are copied.

    Items without audio are left out of their group, those without a transcript add no text; both are counted.
    """
    files.copy_tree(spark, input_vctk_dir, output_vctk_dir, [TEXT_DIR, AUDIO_DIR])
    cat = _catalogue(spark, input_vctk_dir)
    g = spark.read.parquet(groups_path)
    seen = g.select("item").join(cat.select(F.col("name").alias("item"), F.lit(True).alias("audio"), F.col("text").isNotNull().alias("texted")), "item", "left")
    missing = seen.agg(F.count_if(F.col("audio").isNull()), F.count_if(~F.col("texted"))).first()
    g = g.join(cat.select(F.col("name").alias("item")), "item", "left_semi")
    ends = g.groupBy("speaker", "part", "group_no").agg(F.min_by("item", "pos").alias("a"), F.max_by("item", "pos").alias("b"))
    base = F.when(F.col("a") == F.col("b"), X.utterance_of(F.col("a"))).otherwise(F.concat_ws("-", X.utterance_of(F.col("a")), X.utterance_of(F.col("b"))))
    named = ends.select("speaker", "part", "group_no", F.concat_ws("/", "speaker", F.concat(F.substring(F.concat_ws("_", "speaker", base), 1, X.MAX_NAME - 5), F.lit("_mic1"))).alias("segment"))
    plan = g.join(named, ["speaker", "part", "group_no"]).select("segment", "pos", F.col("item").alias("file"), "speaker")
    _write(_assemble(plan, cat, GAP_S, None, scene.ITEM_LEVEL, FADE_S), output_vctk_dir)
    print(f"{named.count()} groups written, {missing[0]} items without audio, {missing[1]} without a transcript")


def multispeaker_conversations(spark: SparkSession, input_vctk_dir: str, output_vctk_dir: str) -> None:
    _copy_info(spark, input_vctk_dir, output_vctk_dir)
    cat = _catalogue(spark, input_vctk_dir)
    items = cat.filter("text is not null").select("speaker", "name", "duration")
    pairs = conversations.speaker_pairs(items.filter(F.col("duration") <= conversations.MAX_TURN_S), "speaker")
    built = conversations.build(items, pairs, "speaker", "name", "duration")
    built = Workspace(spark, "conversations").save(built, "built")
    ids = sorted_rank(built.select("pair_no", "part", "conv").distinct(), ["pair_no", "part", "conv"]).withColumnRenamed("rank", "number")
    name = F.concat_ws("/", F.concat_ws("-", "a", "b"), F.concat(X.conversation_name(F.col("a"), F.col("b"), F.col("number")), F.lit("_mic1")))
    plan = built.join(ids, ["pair_no", "part", "conv"]).join(pairs, "pair_no").select(name.alias("segment"), F.col("turn").alias("pos"), F.col("item").alias("file"), "speaker")
    _write(_assemble(plan, cat, conversations.GAP_S, conversations.MOST_S, None, 0.0), output_vctk_dir, turns=True)


def _clip(spark: SparkSession, path: str, sr: int) -> np.ndarray:
    """A source clip, which is one file, as (2, n) at ``sr``."""
    from voxmill.functions import kernels

    r = wav.read_audio(spark, path, "*").filter("error is null").select("sr", "channels").head(1)
    if not r:
        raise ValueError(f"no readable audio at {path}")
    x = as_signal(r[0]["channels"])
    if x.shape[0] != 2:
        raise ValueError(f"{path} must have two channels")
    return kernels.resampled(x, r[0]["sr"], sr)


SPEECH = "stem string, speaker_id string, samples array<double>"


def mix(
    spark: SparkSession, events_path: str, background_path: str, vctk_path: str, out_dataset_path: str, sr: int = 48000, segment_duration: float = 60, audio_files: bool = False
) -> None:
    """Segments of half to the whole duration in ten conditions, as 16-bit samples partitioned by condition, pan and speaker.

    Files of all microphones and sampling rates that have a transcript; speech is averaged over its
    channels and resampled to ``sr``. Turns, where a file has any, are written per condition. With
    ``audio_files`` each condition is also written as a file below ``ebr-*-sar-*/pan_*/<speaker>``,
    with its turns below ``turns`` and the transcripts below ``transc``.
    """
    def at_rate(batches):
        from voxmill.functions import kernels

        for b in batches:
            for stem, who, path in zip(*[b.column(c).to_pylist() for c in ("stem", "speaker_id", "path")]):
                x, rate = _opened(path)
                x = kernels.resampled(x, rate, sr)[: int(segment_duration * sr)]
                offsets = pa.array([0, len(x)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([who]), pa.ListArray.from_arrays(offsets, pa.array(x))], ["stem", "speaker_id", "samples"])

    cat = _catalogue(spark, vctk_path, "*.{wav,flac}").filter(F.col("duration").between(int(0.5 * segment_duration), segment_duration) & F.col("text").isNotNull())
    cat = cat.withColumn("stem", X.stem(F.col("path"))).withColumnRenamed("speaker", "speaker_id")
    seg = cat.select("stem", "speaker_id", "path").mapInArrow(at_rate, SPEECH)
    out = scene.render(seg, _clip(spark, events_path, sr), _clip(spark, background_path, sr), sr, segment_duration)
    by = ["ebr", "sar", "pan", "speaker_id"]
    out.withColumn("pan", (F.col("pan") * 100).cast("int")).write.mode("overwrite").partitionBy(*by).parquet(f"{out_dataset_path}/mixed.parquet")
    said = cat.select("stem", "text").dropDuplicates(["stem"])
    said.write.mode("overwrite").parquet(f"{out_dataset_path}/transc.parquet")
    turns, mirrored = _turns(spark, vctk_path), None
    if turns is not None:
        mirrored = scene.with_conditions(cat.select("stem", "speaker_id", _key(F.col("path")).alias("key")).join(turns, "key").select("stem", "speaker_id", F.lit(0).alias("pan"), "turns"))
        mirrored.select("stem", *by, "turns").write.mode("overwrite").partitionBy(*by).parquet(f"{out_dataset_path}/turns.parquet")
    _copy_info(spark, vctk_path, out_dataset_path, INFO_FILES[:1])
    if not audio_files:
        return
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    folder = F.concat(X.condition_dir(F.col("ebr"), F.col("sar")), F.lit("/pan_"), F.col("pan").cast("string"), F.lit("/"), "speaker_id", F.lit("/"))
    name = F.concat(folder, X.mixed_name(F.col("speaker_id"), F.col("stem"), F.col("pan") / 100, F.col("ebr"), F.col("sar")))
    done(wav.write_audio(spark.read.parquet(f"{out_dataset_path}/mixed.parquet").select(name.alias("name"), "sr", "channels"), out_dataset_path))
    done(files.write_texts(said.select(F.concat(F.lit("transc/"), "stem", F.lit(".txt")).alias("name"), "text"), out_dataset_path))
    if mirrored is not None:
        done(files.write_csvs(mirrored.select(F.concat(F.lit("turns/"), F.regexp_replace(name, r"\.flac$", ".csv")).alias("name"), "turns"), out_dataset_path, "turns", TURN))


ACTIVITY = "stem string, activity array<int>, error string"


def _guarded(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")
    return path


def vad(spark: SparkSession, dataset_path: str) -> None:
    """Activity of the clean condition only, which is a pruned partition; segments that fail are listed under ``rejects``."""
    def run(batches):
        from voxmill.functions import kernels

        for b in batches:
            for stem, sr, x in zip(b.column("stem").to_pylist(), b.column("sr").to_pylist(), signals(b.column("channels"))):
                active, error = None, None
                try:
                    active = kernels.activity(x.mean(axis=0), sr).tolist()
                except Exception as e:  # noqa: BLE001 - one bad segment must not end the scan
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([active], pa.list_(pa.int32())), pa.array([error], pa.string())], ["stem", "activity", "error"])

    clean = spark.read.parquet(_guarded(spark, f"{dataset_path}/mixed.parquet")).filter("ebr = 'none' and sar = 'none'")
    ws = Workspace(spark, "activity")
    out = ws.save(clean.select("stem", "sr", "channels").mapInArrow(run, ACTIVITY), "activity")
    out.filter("error is null").select(X.activity_name(F.col("stem")).alias("name"), "activity").write.mode("overwrite").parquet(f"{dataset_path}/vadgt.parquet")
    out.filter("error is not null").select("stem", "error").write.mode("overwrite").parquet(f"{dataset_path}/vadgt_rejects.parquet")
    ws.drop(out)


def office_level(spark: SparkSession, keyboard_path: str, office_path: str, output_path: str, sr: int = 48000) -> None:
    level, y = scene.office_level(_clip(spark, keyboard_path, sr), _clip(spark, office_path, sr), sr)
    folder, _, name = output_path.rpartition("/")
    files.put(f"{folder or '.'}/{name}", wav.ENCODERS[name.rsplit(".", 1)[-1].lower()](y, sr))
    print(f"level {level:.2f} dB")


def check_integrity(spark: SparkSession, dataset_path: str, num_speakers: int = 1, num_segments: int = 1, events_path: str | None = None, background_path: str | None = None, check_ebr: bool = False, layout: str = "current") -> int:
    """Audit of the first segments of the first speakers; 1 if any check fails.

    ``current`` reads the table that ``mix`` writes; ``old`` reads audio files below the older folders.
    """
    from voxmill.operators.catalog import first_m_of_first_n

    if layout == "old":
        a = wav.read_audio(spark, _guarded(spark, dataset_path)).filter("error is null")
        part = r"ebr-(\w+)-asr-(\w+)/evaluation/pan_(\d+)/([^/]+)/"
        a = a.filter(F.col("path").rlike(part))
        bare = F.regexp_replace(X.stem(F.col("path")), r"__ebr-\w+-asr-\w+$", "")
        rows = a.select(*[F.regexp_extract("path", part, i).alias(n) for i, n in ((1, "ebr"), (2, "sar"), (4, "speaker_id"))], bare.alias("stem"), "sr", "channels")
    else:
        rows = spark.read.parquet(_guarded(spark, f"{dataset_path}/mixed.parquet")).select("ebr", "sar", "speaker_id", "stem", "sr", "channels")
    chosen = first_m_of_first_n(rows.filter("ebr = 'none' and sar = 'none'").select("speaker_id", "stem").distinct(), "speaker_id", ["stem"], num_speakers, num_segments)
    rows = rows.join(F.broadcast(chosen.select("stem")), "stem", "left_semi").withColumn("mixed_id", F.monotonically_increasing_id())
    ws = Workspace(spark, "audit")
    rows = ws.save(rows, "rows")  # ten conditions of a few segments; their ids are fixed here
    c = ws.save(audit.checks(rows), "checks")
    sr = c.select("sr").first()
    clips = (_clip(spark, events_path, sr[0]), _clip(spark, background_path, sr[0])) if check_ebr and sr and events_path and background_path else (None, None)
    result = c.drop("clean_id", "noisy_id", "sar_db").join(audit.long_checks(audit.with_audio(c, rows), *clips), ["stem", "ebr", "sar"], "left")
    result.orderBy("stem", "ebr", "sar").show(200, False)
    t = audit.totals(result).first()
    print(f"{t['n_checked']} checked, {t['n_failed']} failed")
    return 1 if t["n_failed"] or not t["n_checked"] else 0
