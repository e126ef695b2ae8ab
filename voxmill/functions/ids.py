"""Regular forms of identifiers that are written in many ways."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The regular speaker form is the letter p and seven digits.
SPEAKER_PREFIX, SPEAKER_DIGITS = "p", 7
#: All decimal digits of the basic plane that are not ASCII, and what they mean.
_DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x10000) if unicodedata.decimal(chr(c), None) is not None}


def plain_digits(text: Column) -> Column:
    """``text`` with the decimal digits of any script, full-width ones among them, as ASCII digits."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, "".join(_DIGITS), "".join(_DIGITS.values()))).otherwise(text)


def _pad(digits: Column) -> Column:
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    width = F.greatest(F.length(bare), F.lit(SPEAKER_DIGITS))
    return F.concat(F.lit(SPEAKER_PREFIX), F.lpad(bare, width, "0"))


def regular_speaker(label: Column) -> Column:
    """One speaker label in the regular form; null where the label holds no number.

    Null, blank and nameless labels (``unknown``, ``?``) give null. Prefixes, case, spaces,
    joiners, trailing colons, missing leading zeros and the digits' script or width do not matter.
    """
    digits = F.regexp_extract(plain_digits(label), r"(\d+)", 1)
    return F.when(digits != "", _pad(digits))


def named_speakers(label: Column) -> Column:
    """All speakers that a label names (``a-b``, ``a + b``, ``a_b`` ...), as a distinct array.

    Null and nameless labels give an empty array.
    """
    found = F.regexp_extract_all(plain_digits(label), F.lit(r"(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), _pad))


def regular_name(name: Column) -> Column:
    """Lower case, with spaces and joiners as one ``_``; blank gives null."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-_./]+", "_")
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.when(out != "", out)
