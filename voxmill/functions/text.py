"""Text cleaning and name grammar as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode strings, and the marks of the transcript convention.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
UNINTELLIGIBLE = ("xxx", "yyy", "www")
MAX_NAME = 200


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def raw_words(text: Column) -> Column:
    """White-space separated words; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(raw_words(text))


def _letters(words: Column) -> Column:
    kept = F.filter(words, lambda w: ~w.rlike(r"^\p{Punct}+$"))
    bare = F.transform(kept, lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z']", "")))
    return F.filter(bare, lambda w: w != "")


def clean_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and apostrophes; words of marks only are dropped."""
    return _letters(raw_words(text))


def clean_transcript_tokens(tokens: Column) -> Column:
    """Spoken words of transcript tokens: events, sounds, unintelligible and broken-off marks are dropped.

    Null lists give an empty array; null and empty tokens are dropped.
    """
    def spoken(t: Column) -> Column:
        mark = t.startswith("&=") | t.contains("@") | t.isin(*UNINTELLIGIBLE) | t.startswith("+")
        return t.isNotNull() & (t != "") & ~mark

    return _letters(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), spoken))


def speaker_of(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def utterance_of(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(2))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.split_part(base_name(path), F.lit("."), F.lit(1))


def packed_name(speaker: Column, first: Column, last: Column, n: Column) -> Column:
    """``speaker_first-last_mic1``, or ``speaker_first_mic1`` for a single item, cut to the longest name."""
    span = F.when(n > 1, F.concat_ws("-", first, last)).otherwise(first)
    return F.substring(F.concat(speaker, F.lit("_"), span, F.lit("_mic1")), 1, MAX_NAME)


def conversation_name(a: Column, b: Column, number: Column) -> Column:
    pair = F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    return F.concat(pair, F.format_string("_conv%04d", number))


def condition_dir(ebr: Column, sar: Column) -> Column:
    return F.concat(F.lit("ebr-"), ebr, F.lit("-sar-"), sar)


def mixed_name(speaker: Column, stem_: Column, pan: Column, ebr: Column, sar: Column) -> Column:
    percent = (pan * 100).cast("int").cast("string")
    return F.concat(F.lit("spk_"), speaker, F.lit("__"), stem_, F.lit("__pan_"), percent, F.lit("__"), condition_dir(ebr, sar), F.lit(".flac"))


def activity_name(stem_: Column) -> Column:
    """The second ``__`` field of a stem, else the stem."""
    return F.when(stem_.contains("__"), F.split_part(stem_, F.lit("__"), F.lit(2))).otherwise(stem_)
