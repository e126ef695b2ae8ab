"""Queries of the reference's own operators over the whole test tables, and their DuckDB oracles.

``events`` stands for utterances of bounded pools (user = speaker, value = seconds), ``embeddings``
for waveforms; the other queries run on the tables of the domain itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import signal as S
from voxmill.functions import text as X
from voxmill.operators import audit, catalog, conversations, matching, packing, scene, stats
from voxmill.operators.ordering import sorted_rank

FS = 16_000
R = 6  # digits that doubles are rounded to before they are compared


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans, predicates, lookups -----------------------------------------------------------------


def scan_duration_range(spark, d):
    return catalog.in_range(catalog.first_microphone(_t(spark, d, "utterances")), "duration", 6.0, 10.0).select("row_id", "path", "duration")


def manifest_json_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return _t(spark, d, "events").select("event_id", k.alias("k"), "event_type").filter(F.col("k").between(8.0, 60.0))


def catalog_join(spark, d):
    u = catalog.in_range(catalog.first_microphone(_t(spark, d, "utterances")), "duration", 2.0, 10.0)
    audio = u.select("row_id", "duration", X.base_name(F.col("path")).alias("name"), "text")
    text = audio.filter("text is not null").select("row_id", "text")
    said = _t(spark, d, "turns").groupBy(F.col("original_filename").alias("name")).agg(F.count("*").alias("n_turns"))
    return catalog.with_transcript(audio.drop("text"), text, None, ["row_id"]).join(said, "name", "left").select("row_id", "name", "text", "n_turns")


def _by_name(df: DataFrame) -> DataFrame:
    return df.withColumn("original_filename", X.base_name(F.col("path")))


def semi_join_available(spark, d):
    return catalog.with_audio(_t(spark, d, "turns"), _by_name(_t(spark, d, "utterances")), ["original_filename"]).select("turn_id", "conv", "original_filename")


def anti_join_missing(spark, d):
    return catalog.without_audio(_t(spark, d, "turns"), _by_name(_t(spark, d, "utterances")), ["original_filename"]).select("turn_id", "conv", "original_filename")


def speaker_pool(spark, d):
    p = catalog.speaker_pool(catalog.first_microphone(_t(spark, d, "utterances")))
    return p.groupBy("speaker").agg(F.count("*").alias("n_items"), F.sum("n_words").cast("long").alias("n_words"), F.round(F.sum("duration"), 3).alias("seconds"))


def missing_counters(spark, d):
    a = _t(spark, d, "utterances").agg(
        F.count_if(F.col("text").isNull()).alias("n_no_text"), F.count_if(F.col("turns_path").isNull()).alias("n_no_turns"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.count("*").alias("n"),
    )
    return a


def name_parts(spark, d):
    n = X.base_name(F.col("path"))
    s = X.stem(F.col("path"))
    return _t(spark, d, "utterances").select(
        "row_id", X.speaker_of(n).alias("spk"), X.utterance_of(n).alias("utt_no"), s.alias("stem"),
        X.packed_name(X.speaker_of(n), X.utterance_of(n), F.lit("999"), F.lit(2)).alias("packed"),
        X.conversation_name(X.speaker_of(n), F.lit("p0005000"), F.col("row_id")).alias("conv"),
        X.mixed_name(X.speaker_of(n), s, F.lit(0.5), F.lit("low"), F.lit("high")).alias("mixed"),
        X.activity_name(X.stem(X.mixed_name(X.speaker_of(n), s, F.lit(0.5), F.lit("low"), F.lit("high")))).alias("activity"),
        audit.condition_path(F.concat(F.lit("d/ebr-none-sar-none/"), n), F.lit("mid"), F.lit("low")).alias("condition"),
    )


# --- text and turns -----------------------------------------------------------------------------


def clean_words(spark, d):
    t = _t(spark, d, "utterances")
    return t.select("row_id", F.array_join(X.clean_words(F.col("text")), " ").alias("clean"), F.size(X.clean_words(F.col("text"))).alias("n_clean"), X.word_count(F.col("text")).alias("n_raw"))


def clean_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_raw"), F.size(X.clean_words(F.col("text"))).alias("n_clean"))


def clean_transcript_tokens(spark, d):
    return _t(spark, d, "transcripts").select("row_id", F.array_join(X.clean_transcript_tokens(F.col("tokens")), " ").alias("words"))


def _turn_lengths(spark, d) -> DataFrame:
    return stats.turn_runs(_t(spark, d, "transcripts"), "file", "participant", F.size(X.clean_transcript_tokens(F.col("tokens"))), ["idx", "row_id"])


def turn_runs(spark, d):
    return _turn_lengths(spark, d).select("file", F.col("run").cast("long").alias("run"), "participant", "n_words")


def length_stats(spark, d):
    return stats.summary(_turn_lengths(spark, d), "n_words")


def length_histogram(spark, d):
    n = F.size(X.clean_words(F.col("text")))
    u = _t(spark, d, "utterances").select(n.alias("n")).filter("n > 0")
    t = _t(spark, d, "turns").select(n.alias("n")).filter("n > 0")
    return stats.histograms({"calls": _turn_lengths(spark, d).select("n_words"), "corpus": u, "built": t})


def running_turn_stats(spark, d):
    r = stats.running(_turn_lengths(spark, d), ["file"], "run", "n_words", 50)
    return r.select("file", F.col("i").cast("long").alias("i"), "mean", "std")


def running_match_stats(spark, d):
    """Running mean and deviation of the matched groups' lengths, speaker by speaker."""
    g = match_groups(spark, d).groupBy("speaker", "part", "group_no").agg(F.sum("length").alias("n"))
    return stats.running(g, ["speaker", "part"], "group_no", "n", 50).select("speaker", "part", F.col("i").cast("long").alias("i"), "mean", "std")


def first_m_per_speaker(spark, d):
    return catalog.first_m_of_first_n(_t(spark, d, "mixed"), "speaker_id", ["stem", "mixed_id"], 5, 2).select("speaker_id", "stem", "mixed_id", "rn")


def turn_transcripts(spark, d):
    # The text of one conversation is one record; a conversation is at most a minute long.
    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("")), F.lit("] "), F.coalesce("text", F.lit("")))
    t = _t(spark, d, "turns").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn_id", line.alias("line")))).alias("l"))
    return t.select("conv", F.array_join(F.col("l.line"), "\n").alias("transcript"))


def write_once_transcripts(spark, d):
    return _t(spark, d, "mixed").groupBy("stem").agg(F.min("mixed_id").alias("mixed_id"), F.count("*").alias("n_conditions"))


# --- packing, matching, conversations -----------------------------------------------------------


def _packed(spark, d) -> DataFrame:
    return packing.pack(_t(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


def pack_first_fit(spark, d):
    b = packing.buffers(_packed(spark, d))
    return b.select(F.col("speaker").alias("user_id"), "buf", "first_item", "last_item", "n_items", F.round("len_s", R).alias("len_s"), "kept")


def pack_summary(spark, d):
    b = packing.buffers(_packed(spark, d))
    return b.agg(
        F.count("*").alias("n_buffers"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_discarded"),
        F.round(F.sum(F.when(~F.col("kept"), F.col("len_s")).otherwise(0.0)), 3).alias("discarded_s"),
    )


def pack_unused(spark, d):
    used = _packed(spark, d).filter("kept").select(F.col("item").alias("event_id"))
    e = _t(spark, d, "events").filter((F.col("value") > 0) & (F.col("value") < packing.FLOOR_S))
    return e.join(used, "event_id", "left_anti").select("event_id", "user_id", "value")


def pack_timeline(spark, d):
    p = _packed(spark, d).filter("kept")
    left = F.floor((F.floor(F.lit(packing.CAP_S) * FS) - F.floor(F.col("buf_len") * FS)) / 2).cast("long")
    return p.select(F.col("speaker").alias("user_id"), "buf", "pos", F.col("item").alias("event_id"), F.round("offset_s", R).alias("offset_s"), left.alias("pad_left"))


def unused_audio_pct(spark, d):
    used = _packed(spark, d).filter("kept").select(F.col("item").alias("event_id"), F.lit(True).alias("used"))
    e = _t(spark, d, "events").join(used, "event_id", "left")
    return e.groupBy("event_type").agg(F.round(stats.share_left(e, "value", F.coalesce("used", F.lit(False))), 4).alias("unused_pct"))


def pack_utterances(spark, d):
    u = catalog.first_microphone(_t(spark, d, "utterances"))
    return packing.buffers(packing.pack(u, "speaker", "row_id", "duration", ["path", "row_id"]))


def match_groups(spark, d):
    # One row per distinct length: their number is at most the root of twice the words.
    lengths = {r["n_words"]: r["n"] for r in _turn_lengths(spark, d).groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    u = catalog.first_microphone(_t(spark, d, "utterances")).select("speaker", "row_id", F.size(X.clean_words(F.col("text"))).alias("n"))
    return matching.match(u, lengths, "speaker", "row_id", "n")


def pack_broken(spark, d):
    u = catalog.first_microphone(_t(spark, d, "utterances"))
    return packing.broken(packing.pack(u, "speaker", "row_id", "duration", ["path", "row_id"]), u, "speaker", "row_id", "duration")


def match_broken(spark, d):
    u = catalog.first_microphone(_t(spark, d, "utterances")).select("speaker", "row_id", F.size(X.clean_words(F.col("text"))).alias("n"))
    return matching.broken(match_groups(spark, d), u, "speaker", "row_id", "n")


def conversations_broken(spark, d):
    return conversations.broken(conversations_built(spark, d), _t(spark, d, "events"), "user_id", "event_id", "value")


def speaker_pairs(spark, d):
    return conversations.speaker_pairs(_t(spark, d, "speakers"), "speaker_id")


def _event_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "events").select("user_id", "event_id", "value")
    return e, conversations.speaker_pairs(e, "user_id")


def conversation_attempt(spark, d):
    e, p = _event_pairs(spark, d)
    a = conversations.first_attempt(e, p, "user_id", "event_id", "value")
    return a.select("pair_no", F.col("n_turns").cast("long").alias("n_turns"), F.round("total_s", R).alias("total_s"), "valid")


def conversations_built(spark, d):
    e, p = _event_pairs(spark, d)
    return conversations.build(e, p, "user_id", "event_id", "value")


def conversation_timeline(spark, d):
    t = _t(spark, d, "turns").join(_by_name(_t(spark, d, "utterances")).filter((F.col("duration") > 0) & ~F.isnan("duration")).groupBy("original_filename").agg(F.min("duration").alias("dur")), "original_filename")
    t = conversations.timeline(t, ["conv"], "turn_id", "dur")
    return t.select("turn_id", "conv", F.round("start_s", R).alias("start_s"), F.round("shifted_s", R).alias("shifted_s"))


# --- scenes and audit ---------------------------------------------------------------------------


def condition_grid(spark, d):
    g = scene.with_conditions(_t(spark, d, "mixed").select("stem").filter("stem is not null").distinct())
    return g.select("stem", "ebr", "sar", F.coalesce("ebr_db", F.lit(0.0)).alias("ebr_db"), F.coalesce("sar_db", F.lit(0.0)).alias("sar_db"))


def segment_offsets(spark, d):
    g = scene.with_conditions(_t(spark, d, "mixed").select("stem").filter("stem is not null").distinct()).filter("ebr <> 'none'")
    key = [F.col("stem"), F.col("ebr"), F.col("sar")]
    return g.select("stem", "ebr", "sar", scene.offset(0, key, "events", F.lit(100_000)).alias("ev"), scene.offset(0, key, "background", F.lit(250_000)).alias("bg"))


def completeness_audit(spark, d):
    return audit.checks(_t(spark, d, "mixed")).select("stem", "ebr", "sar", "status")


def audit_levels(spark, d):
    return audit.all_sar_levels(_t(spark, d, "mixed"))


def audit_totals(spark, d):
    c = audit.checks(_t(spark, d, "mixed"))
    levels = audit_levels(spark, d).select("stem", "ebr", "sar", "sar_pass")
    return audit.totals(c.join(levels, ["stem", "ebr", "sar"], "left"))


# --- signals ------------------------------------------------------------------------------------


def _vec(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", S.as_doubles(F.col("embedding")).alias("a"))


def _triples(spark, d) -> DataFrame:
    """Each vector with the next two, around the end: the ids are ranked, and the arrays join them last."""
    ids = sorted_rank(_t(spark, d, "embeddings").select("vec_id"), ["vec_id"])
    n = ids.count()
    after = lambda k, name: ids.select(F.pmod(F.col("rank") - k, F.lit(max(1, n))).alias("rank"), F.col("vec_id").alias(name))
    next_ = ids.join(after(1, "b_id"), "rank").join(after(2, "c_id"), "rank").drop("rank")
    v = lambda name, by: _vec(spark, d).select(F.col("vec_id").alias(by), F.col("a").alias(name))
    return next_.join(v("a", "vec_id"), "vec_id").join(v("b", "b_id"), "b_id").join(v("c", "c_id"), "c_id").select("vec_id", "a", "b", "c")


def level_db(spark, d):
    return _vec(spark, d).select("vec_id", F.round(S.level_db(F.col("a"), FS), R).alias("db"))


def normalize_gain(spark, d):
    v = _vec(spark, d).withColumn("db", S.level_db(F.col("a"), FS))
    v = v.withColumn("out", S.normalized(F.col("a"), F.col("db"), scene.ITEM_LEVEL))
    return v.select("vec_id", F.round(S.gain_of(scene.ITEM_LEVEL - F.col("db")), R).alias("gain"), F.round(S.peak(F.col("out")), R).alias("peak"))


def room_input(spark, d):
    """Peak-normalised vectors, cut or padded to a length, and brought to the speech level."""
    fit = lambda n: S.fitted(S.peak_normalized(F.col("a")), n)
    v = _vec(spark, d).withColumn("y", F.when(F.col("vec_id") % 2 == 0, fit(40)).otherwise(fit(101)))
    v = v.withColumn("gain", S.gain_of(scene.SPEECH_LEVEL - S.level_db(F.col("y"), FS)))
    out = S.scaled(F.col("y"), F.col("gain"))
    total = F.aggregate(F.transform(F.col("y"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return v.select("vec_id", F.size("y").alias("n"), F.round(total, R).alias("moment"), F.round(F.log10("gain"), R).alias("log_gain"), F.round(S.level_db(out, FS), 2).alias("db"))


def fade_pad_concat(spark, d):
    faded = S.faded(F.col("a"), 1000)
    out = S.with_gaps([faded, F.col("a")], S.silence(1000, 0.005))
    v = _vec(spark, d).withColumn("out", S.padded(out, 151)).withColumn("f", faded)
    total = lambda c: F.aggregate(F.transform(F.col(c), lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return v.select("vec_id", F.size("out").alias("n"), F.round(total("out"), R).alias("moment"), F.round(total("f"), R).alias("faded_moment"))


def mix_scene_levels(spark, d):
    t = _triples(spark, d).withColumn("la", S.level_db(F.col("a"), FS)).withColumn("lb", S.level_db(F.col("b"), FS)).withColumn("lc", S.level_db(F.col("c"), FS))
    g = scene.with_conditions(t).filter("ebr <> 'none'")
    g = g.withColumn("gain", S.gain_of(F.col("lc") + F.col("ebr_db") - F.col("lb")))
    g = g.withColumn("amb", S.plus(S.scaled(F.col("b"), F.col("gain")), F.col("c")))
    g = g.withColumn("amb_gain", S.gain_of(F.col("la") - F.col("sar_db") - S.level_db(F.col("amb"), FS)))
    g = g.withColumn("out", S.plus(F.col("a"), S.scaled(F.col("amb"), F.col("amb_gain"))))
    back = F.col("la") - S.level_db(S.minus(F.col("out"), F.col("a")), FS)
    return g.select("vec_id", "ebr", "sar", F.round(S.level_db(F.col("out"), FS), R).alias("db"), F.round(back, R).alias("measured_sar"), (F.abs(back - F.col("sar_db")) <= audit.SAR_TOLERANCE).alias("sar_pass"))


def activity_frames(spark, d):
    v = _vec(spark, d).select("vec_id", F.posexplode(S.activity(F.col("a"), 8, -12.0)).alias("frame", "active"))
    return v


def tile_average(spark, d):
    y = S.tiled_average(F.slice("a", 1, 24), F.col("a"))
    return _vec(spark, d).withColumn("y", y).select("vec_id", F.round(S.level_db(F.col("y"), FS), R).alias("db"), F.round(S.dot(F.col("y"), F.col("y")), R).alias("energy"))


def localize_offset(spark, d):
    """A cut of 16 samples of the next vector, searched in this one at every lag by column expressions."""
    t = _triples(spark, d).select("vec_id", "a", F.slice("b", 11, 16).alias("p"))
    lag = t.withColumn("lag", F.explode(F.sequence(F.lit(0), F.size("a") - F.size("p"))))
    window = F.slice("a", F.col("lag") + 1, F.size("p"))
    lag = lag.withColumn("w", window)
    score = F.abs(S.dot(F.col("w"), F.col("p"))) / F.sqrt(S.dot(F.col("w"), F.col("w")) * S.dot(F.col("p"), F.col("p")))
    s = lag.select("vec_id", "lag", F.round(score, 9).alias("s"))
    m = s.groupBy("vec_id").agg(F.max_by("lag", F.struct("s", -F.col("lag"))).alias("best_lag"), F.max("s").alias("peak"), F.percentile("s", 0.5).alias("middle"))
    return m.select("vec_id", "best_lag", F.round(F.col("peak") / F.col("middle"), R).alias("confidence"))


def unmix_fit(spark, d):
    """y = A a + B b by six sums."""
    t = _triples(spark, d)
    pairs = [("aa", "b", "b"), ("ab", "b", "c"), ("bb", "c", "c"), ("ay", "b", "a"), ("by", "c", "a"), ("yy", "a", "a")]
    t = t.select("vec_id", *[S.dot(F.col(x), F.col(y)).alias(n) for n, x, y in pairs])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    a = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det
    b = (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    r2 = (a * F.col("ay") + b * F.col("by")) / F.col("yy")
    return t.select("vec_id", F.round(a, R).alias("a"), F.round(b, R).alias("b"), F.round(r2, R).alias("r2"), F.round(r2 - F.col("by") * F.col("by") / F.col("bb") / F.col("yy"), R).alias("gain_r2"))


QUERIES = {
    f.__name__: f
    for f in (
        pack_first_fit, scan_duration_range, manifest_json_extract, catalog_join, semi_join_available, anti_join_missing, speaker_pool,
        missing_counters, name_parts, clean_words, clean_documents, clean_transcript_tokens, turn_runs, length_stats, length_histogram,
        running_turn_stats, running_match_stats, pack_broken, match_broken, conversations_broken, first_m_per_speaker, turn_transcripts, write_once_transcripts, pack_summary, pack_unused, pack_timeline,
        unused_audio_pct, pack_utterances, match_groups, speaker_pairs, conversation_attempt, conversations_built, conversation_timeline,
        condition_grid, segment_offsets, completeness_audit, audit_levels, audit_totals, level_db, normalize_gain, room_input, fade_pad_concat,
        mix_scene_levels, activity_frames, tile_average, localize_offset, unmix_fit,
    )
}

# --- oracles ------------------------------------------------------------------------------------

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _raw(t: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({t}, ''), '{_WS}+'), lambda w: w <> '')"


def _letters(w: str) -> str:
    return f"list_filter(list_transform(list_filter({w}, lambda w: not regexp_matches(w, '^[[:punct:]]+$')), lambda w: lower(regexp_replace(w, '[^a-zA-Z'']', '', 'g'))), lambda w: w <> '')"

_CLEAN = _letters(_raw("text"))
_SPOKEN = _letters("list_filter(coalesce(tokens, []), lambda t: t is not null and t <> '' and not (starts_with(t, '&=') or contains(t, '@') or t in ('xxx', 'yyy', 'www') or starts_with(t, '+')))")
_MIC1 = "path like '%\\_mic1.flac' escape '\\'"
_NAME = "regexp_extract(path, '[^/]*$')"
_RUNS = f"""
    spoken as (select *, len({_SPOKEN}) as n from transcripts),
    kept as (select * from spoken where n > 0),
    flagged as (select *, case when lag(row_id) over w is not null and lag(participant) over w is not distinct from participant then 0 else 1 end as c
      from kept window w as (partition by file order by idx, row_id)),
    numbered as (select *, sum(c) over (partition by file order by idx, row_id rows unbounded preceding) as run from flagged),
    runs as (select file, cast(run as bigint) as run, any_value(participant) as participant, cast(sum(n) as bigint) as n_words from numbered group by file, run)
"""
_PACK = """
    recursive r as (
      select user_id, 0 as buf, 1 as i, list({'e': event_id, 'd': value} order by event_id) as pool, 0.0::double as len, []::bigint[] as nm, []::double[] as offs
      from events where value > 0 and value < 45 group by 1
      union all
      select user_id,
        case when i > len(pool) then buf + 1 else buf end,
        case when i > len(pool) then 1 when fit then i else i + 1 end,
        case when i <= len(pool) and fit then pool[:i-1] || pool[i+1:] else pool end,
        case when i > len(pool) then 0.0 when fit then (case when len(nm) > 0 then x.len + 0.1::double else x.len end) + pool[i].d else x.len end,
        case when i > len(pool) then [] when fit then list_append(nm, pool[i].e) else nm end,
        case when i > len(pool) then [] when fit then list_append(offs, case when len(nm) > 0 then x.len + 0.1::double else x.len end) else offs end
      from (select *, r.len + (pool[i].d + case when len(nm) > 0 then 0.1::double else 0.0 end) <= 60.0 as fit
            from r where not (i > len(pool) and len(pool) = 0)) x),
    bufs as (select * from r where i > len(pool)),
    used as (select user_id, buf, unnest(nm) as event_id, unnest(offs) as o, generate_subscripts(nm, 1) - 1 as pos, len from bufs where len >= 45.0)
"""
_GRID = """
    grid as (select * from (values ('low', -50.0), ('mid', 3.0), ('high', 12.0)) e(ebr, ebr_db), (values ('low', 20.0), ('mid', 10.0), ('high', 0.0)) s(sar, sar_db))
"""


def _level(source: str, name: str, fs: int = FS) -> str:
    """Common tables that give ``name`` (k, db) from ``source`` (k, a), sample by sample; the source must be a table or CTE."""
    (s1, s2, s3, s4), gain = S.sections(fs)
    n = [f"{b0!r}::double * ({{}}) - ({a1!r}::double) * " for b0, a1 in (s1, s2, s3, s4)]
    return f"""
    {name}_st as (
      select k, a, 0 as i, 0.0::double as x, 0.0::double as y1, 0.0::double as y2, 0.0::double as y3, 0.0::double as y4, 0.0::double as ss from {source} where len(a) > 0
      union all
      select k, a, i + 1, v, n1, n2, n3, n4, ss + ({gain!r}::double * n4) * ({gain!r}::double * n4) from (
        select *, {n[3].format('n3 - y3')} y4 as n4 from (
        select *, {n[2].format('n2 - y2')} y3 as n3 from (
        select *, {n[1].format('n1 - y1')} y2 as n2 from (
        select *, a[i + 1] as v, {n[0].format('a[i + 1] - x')} y1 as n1 from {name}_st where i < len(a)))))),
    {name} as (select k, 20 * log10(sqrt(ss / len(a)) + 1e-12) as db from {name}_st where i = len(a))"""


_VEC = "vec as (select vec_id as k, embedding::double[] as a, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings)"
_TRIPLE = _VEC + """, triple as (
    select v.k, v.a, b.a as b, c.a as c from vec v join vec b on b.i = (v.i + 1) % v.n join vec c on c.i = (v.i + 2) % v.n)"""
_DOT = "list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]))"
_MONO = "list_transform(range(1, len({c}[1]) + 1), lambda i: list_sum(list_transform({c}, lambda q: q[i])) / len({c}))"
_CHECKS = f"""
    one as (select stem, ebr, sar, arg_min({{'sr': sr, 'channels': channels}}, mixed_id) as a from mixed where stem is not null group by all),
    {_GRID},
    chk as (
      select c.stem, g.ebr, g.sar, g.sar_db, c.a.sr as sr, c.a.channels as clean, m.a.channels as noisy,
        case when m.a is null then 'MISSING'
          when c.a.sr = m.a.sr and len(c.a.channels) = len(m.a.channels) and coalesce(len(c.a.channels[1]), -1) = coalesce(len(m.a.channels[1]), -1)
            and coalesce(len(c.a.channels[2]), -1) = coalesce(len(m.a.channels[2]), -1) then 'CHECKED' else 'MISMATCH' end as status
      from one c cross join grid g left join one m on m.stem = c.stem and m.ebr = g.ebr and m.sar = g.sar
      where c.ebr = 'none' and c.sar = 'none')
"""


def _audit_levels_sql() -> str:
    parts, unions = [], []
    for fs in (16_000, 44_100, 48_000):
        t = f"r{fs}"
        parts.append(f"{t}_s as (select stem || '|' || ebr || '|' || sar as k, {_MONO.format(c='clean')} as a from chk where status = 'CHECKED' and sr = {fs})")
        parts.append(f"{t}_n as (select stem || '|' || ebr || '|' || sar as k, {_MONO.format(c='noisy')} as a from chk where status = 'CHECKED' and sr = {fs})")
        parts.append(f"{t}_m as (select s.k, list_transform(list_zip(n.a, s.a), lambda z: z[1] - z[2]) as a from {t}_s s join {t}_n n using (k))")
        parts.append(_level(f"{t}_s", f"{t}_ls", fs))
        parts.append(_level(f"{t}_m", f"{t}_lm", fs))
        unions.append(f"select s.k, s.db - m.db as measured from {t}_ls s join {t}_lm m using (k)")
    return ",".join(parts) + f", measured as ({' union all '.join(unions)})"


_MIXED = f"""
    with recursive {_TRIPLE},
    ta as (select k, a from triple), tb as (select k, b as a from triple), tc as (select k, c as a from triple),
    {_level('ta', 'la')}, {_level('tb', 'lb')}, {_level('tc', 'lc')}, {_GRID},
    amb as (
      select t.k || '|' || ebr || '|' || sar as k, t.k as vec_id, ebr, sar, sar_db, t.a as speech, la.db as ldb,
        list_transform(list_zip(t.b, t.c), lambda z: z[1] * pow(10.0, (lc.db + ebr_db - lb.db) / 20) + z[2]) as a
      from triple t join la using (k) join lb using (k) join lc using (k), grid),
    {_level('amb', 'lamb')},
    mixed_out as (
      select k, vec_id, ebr, sar, sar_db, ldb, speech,
        list_transform(list_zip(speech, a), lambda z: z[1] + z[2] * pow(10.0, (ldb - sar_db - lamb.db) / 20)) as a
      from amb join lamb using (k)),
    rest as (select k, list_transform(list_zip(a, speech), lambda z: z[1] - z[2]) as a from mixed_out),
    {_level('mixed_out', 'lout')}, {_level('rest', 'lrest')}
    select vec_id, ebr, sar, round(lout.db, 6) as db, round(ldb - lrest.db, 6) as measured_sar, abs(ldb - lrest.db - sar_db) <= 0.5 as sar_pass
    from mixed_out join lout using (k) join lrest using (k)
"""

ORACLES = {
    "scan_duration_range": f"select row_id, path, duration from utterances where {_MIC1} and duration between 6 and 10 and not isnan(duration)",
    "manifest_json_extract": "select * from (select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, event_type from events) where k between 8 and 60",
    "catalog_join": f"""
        select u.row_id, {_NAME} as name, regexp_replace(regexp_replace(u.text, '^{_WS}+', ''), '{_WS}+$', '') as text, n as n_turns
        from utterances u left join (select original_filename as f, count(*) as n from turns group by 1) t on t.f = {_NAME}
        where {_MIC1} and duration between 2 and 10 and not isnan(duration) and u.text is not null""",
    "semi_join_available": f"select turn_id, conv, original_filename from turns where original_filename in (select {_NAME} from utterances where path is not null)",
    "anti_join_missing": f"select turn_id, conv, original_filename from turns where original_filename is null or original_filename not in (select {_NAME} from utterances where path is not null)",
    "speaker_pool": f"""
        select speaker, count(*) as n_items, cast(sum(len({_raw('text')})) as bigint) as n_words, round(sum(duration), 3) as seconds
        from utterances where {_MIC1} and duration <= 20 and not isnan(duration) group by 1""",
    "missing_counters": """
        select count(*) filter (text is null) as n_no_text, count(*) filter (turns_path is null) as n_no_turns,
          count(*) filter (coalesce(text, '') = '') as n_empty, count(*) as n from utterances""",
    "name_parts": f"""
        select row_id, spk, utt_no, stem, spk || '_' || utt_no || '-999_mic1' as packed,
          least(spk, 'p0005000') || '-' || greatest(spk, 'p0005000') || '_conv' || lpad(row_id::varchar, greatest(4, length(row_id::varchar))::int, '0') as conv,
          'spk_' || spk || '__' || stem || '__pan_50__ebr-low-sar-high.flac' as mixed, stem as activity, 'd/ebr-mid-sar-low/' || name as condition
        from (select row_id, {_NAME} as name, split_part({_NAME}, '_', 1) as spk, split_part({_NAME}, '_', 2) as utt_no, split_part({_NAME}, '.', 1) as stem from utterances)""",
    "clean_words": f"select row_id, array_to_string({_CLEAN}, ' ') as clean, cast(len({_CLEAN}) as int) as n_clean, cast(len({_raw('text')}) as int) as n_raw from utterances",
    "clean_documents": f"select doc_id, cast(len({_raw('text')}) as int) as n_raw, cast(len({_CLEAN}) as int) as n_clean from documents",
    "clean_transcript_tokens": f"select row_id, array_to_string({_SPOKEN}, ' ') as words from transcripts",
    "turn_runs": f"with {_RUNS} select file, run, participant, n_words from runs",
    "length_stats": f"with {_RUNS} select count(*) as n, round(avg(n_words), 6) as mean, round(stddev_pop(n_words), 6) as std, min(n_words) as least, max(n_words) as most from runs",
    "length_histogram": f"""
        with {_RUNS},
        every as (select n_words as value, 'calls' as tag from runs
          union all select len({_CLEAN}), 'corpus' from utterances where len({_CLEAN}) > 0
          union all select len({_CLEAN}), 'built' from turns where len({_CLEAN}) > 0)
        select value, count(*) filter (tag = 'calls') as n_calls, count(*) filter (tag = 'corpus') as n_corpus, count(*) filter (tag = 'built') as n_built
        from every where value <= 40 group by 1""",
    "pack_broken": "select 0::bigint as item, '' as fault where false",
    "match_broken": "select 0::bigint as item, 0::bigint as want, 0::bigint as n where false",
    "conversations_broken": "select 0::bigint as pair_no, 0::int as conv, '' as fault where false",
    "running_turn_stats": f"""
        with {_RUNS},
        s as (select file, row_number() over w as i, round(avg(n_words) over w, 6) as mean, round(stddev_pop(n_words) over w, 6) as std, count(*) over (partition by file) as n
          from runs window w as (partition by file order by run rows unbounded preceding))
        select file, i, mean, std from s where i % 50 = 0 or i = n""",
    "first_m_per_speaker": """
        select speaker_id, stem, mixed_id, cast(rn as int) as rn from (
          select *, row_number() over (partition by speaker_id order by stem nulls first, mixed_id) as rn from mixed
          where speaker_id in (select distinct speaker_id from mixed where speaker_id is not null order by 1 limit 5)) where rn <= 2""",
    "turn_transcripts": """
        select conv, string_agg('[' || coalesce(speaker, '') || '] ' || coalesce(text, ''), chr(10) order by turn_id) as transcript from turns group by 1""",
    "write_once_transcripts": "select stem, min(mixed_id) as mixed_id, count(*) as n_conditions from mixed group by 1",
    "pack_first_fit": f"with {_PACK} select user_id, buf, nm[1] as first_item, nm[-1] as last_item, cast(len(nm) as bigint) as n_items, round(bufs.len, 6) as len_s, bufs.len >= 45.0 as kept from bufs",
    "pack_summary": f"""with {_PACK} select count(*) as n_buffers, count(*) filter (b.len >= 45.0) as n_kept, count(*) filter (b.len < 45.0) as n_discarded,
        round(coalesce(sum(b.len) filter (b.len < 45.0), 0), 3) as discarded_s from bufs b""",
    "pack_unused": f"with {_PACK} select event_id, user_id, value from events where value > 0 and value < 45 and event_id not in (select event_id from used)",
    "pack_timeline": f"with {_PACK} select user_id, buf, cast(pos as int) as pos, event_id, round(o, 6) as offset_s, cast(floor((floor(60.0::double * {FS}) - floor(len * {FS})) / 2) as bigint) as pad_left from used",
    "unused_audio_pct": f"""with {_PACK} select event_type, round(coalesce(100 * sum(case when event_id in (select event_id from used) then 0.0 else value end) / nullif(sum(value), 0), 0.0), 4) as unused_pct
        from events group by 1""",
    "speaker_pairs": """
        with s as (select speaker_id as s, row_number() over (order by speaker_id) as rn from (select distinct speaker_id from speakers where speaker_id is not null))
        select cast((a.rn - 1) // 2 as bigint) as pair_no, a.s as a, b.s as b from s a join s b on b.rn = a.rn + 1 where a.rn % 2 = 1""",
    "conversation_attempt": """
        with u as (select user_id, row_number() over (order by user_id) as rn, count(*) over () as n from (select distinct user_id from events where user_id is not null)),
        side as (select user_id, (rn - 1) // 2 as pair_no, (rn - 1) % 2 as side from u where n % 2 = 0 or rn < n),
        t as (select s.pair_no, s.side, e.value as d, row_number() over (partition by s.pair_no, s.side order by md5('0|0|' || event_id), event_id) as k
          from events e join side s using (user_id) where value > 0 and value <= 20),
        c as (select *, 2 * (k - 1) + side as turn, count(*) filter (side = 0) over (partition by pair_no) as n0, count(*) filter (side = 1) over (partition by pair_no) as n1 from t),
        r as (select *, sum(d + case when turn > 0 then 0.5 else 0.0 end) over (partition by pair_no order by turn) as total from c
          where turn < case when n0 <= n1 then 2 * n0 else 2 * n1 + 1 end)
        select cast(pair_no as bigint) as pair_no, cast(min(turn) + 1 as bigint) as n_turns, round(arg_min(total, turn), 6) as total_s, arg_min(total, turn) <= 60.0 as valid
        from r where total >= 48.0 group by pair_no""",
    "conversation_timeline": f"""
        with d as (select {_NAME} as f, min(duration) as dur from utterances where duration > 0 and not isnan(duration) group by 1),
        t as (select turn_id, conv, coalesce(sum(dur + 0.5) over (partition by conv order by turn_id rows between unbounded preceding and 1 preceding), 0.0) as s,
            sum(dur + 0.5) over (partition by conv) - 0.5 as total from turns join d on d.f = original_filename)
        select turn_id, conv, round(s, 6) as start_s, round(s + greatest(0.0, 60.0 - total) / 2, 6) as shifted_s from t""",
    "condition_grid": f"""
        with {_GRID}, s as (select distinct stem from mixed where stem is not null)
        select stem, ebr, sar, ebr_db::double as ebr_db, sar_db::double as sar_db from s, grid union all select stem, 'none', 'none', 0.0, 0.0 from s""",
    "segment_offsets": f"""
        with {_GRID}, s as (select distinct stem from mixed where stem is not null)
        select stem, ebr, sar, ('0x' || substring(md5('0|' || stem || '|' || ebr || '|' || sar || '|events'), 1, 12))::bigint % 100000 as ev,
          ('0x' || substring(md5('0|' || stem || '|' || ebr || '|' || sar || '|background'), 1, 12))::bigint % 250000 as bg from s, grid""",
    "completeness_audit": f"with {_CHECKS} select stem, ebr, sar, status from chk",
    "audit_levels": f"""
        with recursive {_CHECKS}, {_audit_levels_sql()}
        select stem, ebr, sar, round(measured, 6) as measured_sar, round(measured - sar_db, 6) as diff, abs(measured - sar_db) <= 0.5 as sar_pass
        from chk left join measured on k = stem || '|' || ebr || '|' || sar where status = 'CHECKED' and sr in (16000, 44100, 48000)""",
    "audit_totals": f"""
        with recursive {_CHECKS}, {_audit_levels_sql()}
        select count(*) as n_checked, cast(count(*) filter (status <> 'CHECKED') + count(*) filter (abs(measured - sar_db) > 0.5) as bigint) as n_failed
        from chk left join measured on status = 'CHECKED' and k = stem || '|' || ebr || '|' || sar""",
    "room_input": f"""
        with recursive {_VEC},
        unit as (select k, list_transform(a, lambda x: x / (list_max(list_transform(a, lambda y: abs(y))) + 1e-9)) as a from vec),
        y as (select k, case when k % 2 = 0 then a[1:40]
            else list_concat(list_transform(range(18), lambda i: 0.0), a, list_transform(range(19), lambda i: 0.0)) end as a from unit),
        {_level('y', 'l')}
        select k as vec_id, cast(len(a) as int) as n, round(list_sum(list_transform(a, lambda x, i: x * i)), 6) as moment,
          round((-136.93 - db) / 20, 6) as log_gain, cast(-136.93 as double) as db from y join l using (k)""",
    "level_db": f"with recursive {_VEC}, {_level('vec', 'l')} select k as vec_id, round(db, 6) as db from l",
    "normalize_gain": f"""
        with recursive {_VEC}, {_level('vec', 'l')},
        g as (select k, pow(10.0, (-130.0 - db) / 20) as gain, list_max(list_transform(a, lambda x: abs(x))) as p from vec join l using (k))
        select k as vec_id, round(gain, 6) as gain, round(least(p * gain, 1.0), 6) as peak from g""",
    "fade_pad_concat": f"""
        with {_VEC},
        f as (select k, a, list_transform(a, lambda x, i: case when i <= 10 then x * ((i - 1) / 9.0::double) when i > 54 then x * ((64 - i) / 9.0::double) else x end) as f from vec),
        o as (select k, f, list_transform(range(9), lambda z: 0.0::double) || f || list_transform(range(5), lambda z: 0.0::double) || a || list_transform(range(9), lambda z: 0.0::double) as o from f)
        select k as vec_id, cast(len(o) as int) as n, round(list_sum(list_transform(o, lambda x, i: x * i)), 6) as moment, round(list_sum(list_transform(f, lambda x, i: x * i)), 6) as faded_moment from o""",
    "mix_scene_levels": _MIXED,
    "activity_frames": f"""
        with {_VEC}, p as (select k, a, list_max(list_transform(a, lambda x: abs(x))) as p from vec),
        f as (select k, p, unnest(range(0, 8)) as frame, a from p)
        select k as vec_id, cast(frame as int) as frame, cast(20 * log10(sqrt(list_sum(list_transform(a[frame * 8 + 1 : frame * 8 + 8], lambda x: case when p > 0 then (x / p) * (x / p) else 0.0 end)) / 8) + 1e-12) >= -12.0 as int) as active from f""",
    "tile_average": f"""
        with recursive {_VEC}, y as (select k, list_transform(a, lambda x, i: (a[(i - 1) % 24 + 1] + x) / 2) as a from vec), {_level('y', 'l')}
        select k as vec_id, round(db, 6) as db, round(list_sum(list_transform(a, lambda x: x * x)), 6) as energy from y join l using (k)""",
    "localize_offset": f"""
        with {_TRIPLE}, p as (select k, a, b[11:26] as p, unnest(range(0, 49)) as lag from triple),
        w as (select *, a[lag + 1 : lag + 16] as w from p),
        s as (select k, lag, round(abs({_DOT.format(x='w', y='p')}) / sqrt({_DOT.format(x='w', y='w')} * {_DOT.format(x='p', y='p')}), 9) as s from w)
        select k as vec_id, cast(first(lag order by s desc, lag) as int) as best_lag, round(max(s) / quantile_cont(s, 0.5), 6) as confidence from s group by k""",
    "unmix_fit": f"""
        with {_TRIPLE},
        s as (select k, {_DOT.format(x='b', y='b')} as aa, {_DOT.format(x='b', y='c')} as ab, {_DOT.format(x='c', y='c')} as bb, {_DOT.format(x='b', y='a')} as ay, {_DOT.format(x='c', y='a')} as cy, {_DOT.format(x='a', y='a')} as yy from triple),
        f as (select *, (ay * bb - cy * ab) / (aa * bb - ab * ab) as fa, (cy * aa - ay * ab) / (aa * bb - ab * ab) as fb from s)
        select k as vec_id, round(fa, 6) as a, round(fb, 6) as b, round((fa * ay + fb * cy) / yy, 6) as r2, round((fa * ay + fb * cy) / yy - cy * cy / bb / yy, 6) as gain_r2 from f""",
}
