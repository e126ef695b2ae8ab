"""Queries of the training-data operators, and the oracles of those that SQL can express."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import containers, langid, mixing, percentiles, repeats, sampling, splits, transcripts


def _p1_found(spark, sf_dir):
    t = transcripts.clean_turns(spark.read.parquet(f"{sf_dir}/transcripts.parquet"))
    return t.select("file", "participant", t["first_idx"].cast("int").alias("first_idx"), t["last_idx"].cast("int").alias("last_idx"))


def _p1_turns(spark, sf_dir):
    p = transcripts.turn_parts(spark.read.parquet(f"{sf_dir}/transcripts.parquet"))
    return p.selectExpr("file", "participant", "run_first as turn_first_idx", "first_idx", "last_idx", "n_events as n_utterances", "start_ms", "end_ms", "text")


def _p5_found(spark, sf_dir):
    r = repeats.found(spark, sf_dir)
    return r.select("file", r["first_idx"].cast("int").alias("first_idx"), r["last_idx"].cast("int").alias("last_idx"))


def _p5_events(spark, sf_dir):
    r = repeats.repeat_runs(spark.read.parquet(f"{sf_dir}/transcripts.parquet"))
    return r.select("file", "first_idx", "last_idx", "participant", "n_events", "duration_ms")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _people(labels: pd.Series) -> pd.Series:
    """Numbers in a label as ids, read by Unicode's compatibility forms instead of the operator's digit table."""
    return labels.map(lambda s: [f"p{int(n):07d}" for n in re.findall(r"\d+", unicodedata.normalize("NFKC", s))] if isinstance(s, str) else [])


def _p2_torn(spark, sf_dir):
    """Known people, and conversations, with rows in several splits: there must be none."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("speakers", "utterances", "turns", "mixed")}
    none = F.lit(None).cast("string")
    rows = t["utterances"].select(F.lit("utterances").alias("table_name"), "row_id", _people("speaker").alias("who"), none.alias("conv"))
    rows = rows.unionByName(t["turns"].select(F.lit("turns").alias("table_name"), F.col("turn_id").alias("row_id"), _people("speaker").alias("who"), "conv"))
    rows = rows.unionByName(t["mixed"].select(F.lit("mixed").alias("table_name"), F.col("mixed_id").alias("row_id"), _people("speaker_id").alias("who"), none.alias("conv")))
    placed = rows.join(splits.assign_splits(spark, sf_dir), ["table_name", "row_id"], "left")
    people = placed.select(F.explode("who").alias("unit"), "split").distinct().join(t["speakers"].select(F.col("speaker_id").alias("unit")), "unit", "left_semi")
    convs = placed.filter("conv is not null").select(F.concat(F.lit("conv "), F.col("conv")).alias("unit"), "split").distinct()
    return people.unionByName(convs).groupBy("unit").agg(F.count("*").alias("n_splits")).filter("n_splits > 1")


def _p5_covered(spark, sf_dir):
    """Events and positions that the runs of each file cover: all of them, once."""
    r = repeats.repeat_runs(spark.read.parquet(f"{sf_dir}/transcripts.parquet"))
    return r.groupBy("file").agg(F.sum("n_events").alias("n_events"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"))


QUERIES = {
    "p1_found": _p1_found,
    "p1_turns": _p1_turns,
    "p2_found": splits.found,
    "p2_splits": splits.assign_splits,
    "p2_report": splits.report,
    "p2_torn": _p2_torn,
    "p2_classes": splits.speaker_classes,
    "p4_found": sampling.found,
    "p4_report": sampling.report,
    "p4_sample": sampling.sample,
    "p4_broken": sampling.broken,
    "p5_found": _p5_found,
    "p5_events": _p5_events,
    "p5_covered": _p5_covered,
    "p6_percentiles": percentiles.report,
    "p7_found": containers.found,
    "p7_filled": containers.filled,
    "p7_report": containers.fill_report,
    "p7_broken": containers.broken,
    "p8_found": mixing.found,
    "p8_mixed": mixing.mixed,
    "p8_report": mixing.report,
    "p8_strays": mixing.off_share,
    "p9_found": langid.found,
    "p9_documents": lambda spark, sf_dir: langid.documents(spark.read.parquet(f"{sf_dir}/documents.parquet")),
    "p9_segments": lambda spark, sf_dir: langid.segments(spark.read.parquet(f"{sf_dir}/documents.parquet")),
}

_USABLE = "select utterance_id, max(words) as words from utterances where words > 0 and utterance_id is not null group by 1"

# Code points of full-width digits are moved to those of ASCII; whatever else is no digit parts the numbers.
_NUMBERS = """list_filter(string_split(list_aggregate(list_transform(string_split({c}, ''), lambda x:
    case when x between '0' and '9' then x when unicode(x) between 65296 and 65305 then chr(cast(unicode(x) - 65248 as int)) else ' ' end), 'string_agg', ''), ' '), lambda x: x <> '')"""
_SPEAKER = f"'p' || lpad(ltrim(({_NUMBERS})[1], '0'), 7, '0')"

_PROBS = ", ".join(f"({p})" for p in percentiles.REPORTED)

_REACH = f"""
        with recursive talk as (
          select distinct conv, {_SPEAKER.format(c='speaker')} as s from turns),
        named as (
          select distinct list_transform({_NUMBERS.format(c='speaker_id')}, lambda y: 'p' || lpad(ltrim(y, '0'), 7, '0')) as n from mixed),
        link as (
          select a.s as a, b.s as b from talk a join talk b using (conv) where a.s <> b.s
          union select x, y from (select n, unnest(n) as x from named) t, unnest(t.n) u(y) where x <> y
          union select speaker_id, {_SPEAKER.format(c='same_as')} from speakers
          union select {_SPEAKER.format(c='same_as')}, speaker_id from speakers),
        known as (select a, b from link where a in (select speaker_id from speakers) and b in (select speaker_id from speakers) and a <> b),
        reach as (select speaker_id as a, speaker_id as b from speakers union select r.a, k.b from reach r join known k on r.b = k.a)
"""

ORACLES = {
    "p2_torn": "select '' as unit, 0::bigint as n_splits where false",
    "p4_broken": "select 0::int as plan_id, '' as band, 0::bigint as n where false",
    "p5_covered": """
        select file, count(distinct idx) as n_events, cast(min(idx) as bigint) as first_idx, cast(max(idx) as bigint) as last_idx
        from transcripts where file is not null and idx is not null group by 1
    """,
    "p7_broken": "select '' as container, '' as bin, 0::bigint as doc_id where false",
    "p8_strays": "select 0::int as mix_id, '' as source, 0::int as slot, 0::double as off_tokens where false",
    "p6_percentiles": f"""
        with x as (
          select k.d as dimension, k.g as grp, measure, value
          from (select k, unnest(['duration', 'words']) as measure, unnest([duration, words]) as value from
            (select unnest([{{d: 'mic', g: mic}}, {{d: 'sr', g: sr::varchar}}, {{d: 'day', g: recorded_at::date::varchar}},
              {{d: 'speaker', g: {_SPEAKER.format(c='speaker')}}}]) as k,
              duration, words::double as words from utterances))
          where isfinite(value)),
        r as (
          select *, row_number() over (partition by dimension, grp, measure order by value) as r,
            count(*) over (partition by dimension, grp, measure) as n from x)
        select dimension, grp, measure, n, cast(p as double) as p, value
        from r join (values {_PROBS}) as t(p) on r = greatest(1, ceil(round(cast(p as double) * n, 6)))
    """,
    "p2_found": f"""{_REACH}
        select a as speaker_a, b as speaker_b from reach where a < b
    """,
    "p2_classes": f"""{_REACH}
        select a as speaker_id, min(b) as class_id, count(*) as n_members from reach group by a
    """,
    "p4_found": f"""
        with u as ({_USABLE}), n as (select count(*) as n from u)
        select plan_id, band from (
          select plan_id, band, min_rows, target_share * sample_frac * (select n from n) as part,
            (select count(*) from u where words between lo_words and hi_words) as c from length_targets)
        where c < greatest(min_rows, part)
    """,
    "p4_report": f"""
        with u as ({_USABLE}), n as (select count(*) as n from u),
        t as (select *, target_share * sample_frac * (select n from n) as part, cast(round_even(sample_frac * (select n from n), 0) as bigint) as size,
            (select count(*) from u where words between lo_words and hi_words) as c from length_targets),
        seat as (
          select plan_id, band, size, r <= least(min_rows, c) as floor,
            row_number() over (partition by plan_id order by r > least(min_rows, c), case when r > least(min_rows, c) then (r - 0.5) / target_share else 0 end, lo_words, band, r) as place,
            sum(case when r <= least(min_rows, c) then 1 else 0 end) over (partition by plan_id) as floors
          from t, lateral (select unnest(range(1, c + 1)) as r))
        select plan_id, band, target_share, min_rows, c as available, cast(greatest(min_rows, part) as double) as required,
          (select count(*) from seat s where s.plan_id = t.plan_id and s.band = t.band and place <= greatest(s.size, s.floors)) as taken,
          c < greatest(min_rows, part) as short from t
    """,
}
