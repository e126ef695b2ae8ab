"""Speech transcripts into clean, ordered speaker turns (problem 1).

Each row's tokens are joined and parsed by a parsing-expression grammar; the tree's words, noises
and times make the cleaned utterance. Labels have a grammar of their own. Turns are then runs of
one participant over the utterances that count (see ``voxmill.llm.runs``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm.peg import Grammar
from voxmill.llm.runs import pieces, runs, with_run_start

# The marks of the transcript conventions.
UTTERANCE = r"""
Utterance <- (Plain / Filler / Unclear / Word / Space / Mark / Time / Event / Code / Stray)*
Plain     <- ~"(?:(?!(?i:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m+h+m+|mm+|xxx|yyy|www)(?![\w'’]))[A-Za-z]++(?:['’][A-Za-z]++)*+[.,!?…]*+(?:\s++[.,!?…]++)*+(?:\s++|$))++"
Space     <- ~"\s+"
Time      <- &~"[\x15<\d\[(]" (Bullet / Tag / Clock / Seconds / Span)
Bullet    <- '\x15' ~"[\d_\s]*" '\x15'
Tag       <- ~"<t\s*=\s*[\d.:]+>"
Clock     <- ('[' / '(' / '<')? ~"\d{1,3}(:\d{2}){1,2}([.,]\d+)?" (']' / ')' / '>')? End
Seconds   <- ~"\d+([.,]\d+)?s" End
Span      <- ~"\d+[_-]\d+" End
Event     <- &~"[&\[(<*]" (Coded / Bracketed / Starred)
Coded     <- '&=' Name
Bracketed <- '[' Inner ']' / '(' Inner ')' / '<' Inner '>'
Inner     <- (Bracketed / Starred / Name / ~"[^\w\[\]()<>*]+")*
Starred   <- '*' (Name / ~"[ \t]+")+ '*'
Name      <- ~"\w+(:\w+)*"
Code      <- &~"[&@+\w'’-]" (Sound / Broken / Pause / ~"[&@]\S*" / ~"\+\S*")
Sound     <- ~"[\w'’-]*@\S*"
Broken    <- ~"&\+\S*"
Pause     <- ~"&-?[^\W\d_]+"
Unclear   <- ~"(?i:xxx|yyy|www)(?![\w'])"
Filler    <- ~"(?i:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m+h+m+|mm+)(?![\w'’])"
Word      <- ~"['’]?[^\W\d_]++(?:['’-]*\w)*+['’]?+(?!@)[.,!?;:…]*\s*"
Mark      <- ~"[^\w\s&@+\[\](<*\x15]+"
Stray     <- ~"\d[\w.,:]*" / ~"\S"
End       <- ~"(?=[\s.,!?;:…]|$)"
"""

LABEL = r"""
Label  <- Space Open Prefix? Letter Close Space End
Space  <- ~"\s*"
Open   <- ~"[*\[(<]*\s*"
Prefix <- ~"(?i:speaker|spk|participant|spkr)[\s_\-.:]*"
Letter <- ~"[A-Za-z](?![A-Za-z0-9])"
Close  <- ~"\s*[\])>:*.]*"
End    <- ~"\Z"
"""

PLAIN, SPOKEN, NOISE, TIME = "Plain", "Word", "Event", "Time"


@lru_cache(maxsize=1)
def _utterance() -> Grammar:
    return Grammar(UTTERANCE)


@lru_cache(maxsize=1)
def _label() -> Grammar:
    return Grammar(LABEL)


@lru_cache(maxsize=65536)
def regular_participant(label: str | None) -> str | None:
    """The capital letter that a participant label means, in any width; None for none, blank or another name."""
    if not isinstance(label, str):
        return None
    label = label if label.isascii() else unicodedata.normalize("NFKC", label)
    tree = _label().parse(label)
    if tree is None:
        return None
    return next(label[n.start : n.end].upper() for n in tree.children if n.rule == "Letter")


def regular_word(word: str) -> str:
    """Lower case, one apostrophe, no other marks; compatibility forms are composed."""
    w = word.lower()
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w).replace("’", "'")
    return re.sub(r"[^\w']|_", "", w).strip("'") if not w.isalpha() else w


def _names(node, text: str, found: list[str]) -> None:
    for n in node.children:
        if n.rule == "Name":
            found.append(re.sub(r"[:_\s]+", " ", text[n.start : n.end]).strip().lower())
        else:
            _names(n, text, found)


def parse_utterance(tokens) -> tuple[list[str], list[str], int]:
    """(spoken words, noises, number of times) of a token list; null and blank tokens are skipped."""
    return parse_text(" ".join([t for t in tokens if t]) if tokens is not None else "")


def parse_text(text: str | None) -> tuple[list[str], list[str], int]:
    """``parse_utterance`` of tokens that are joined already; runs of plain words are one node of the tree."""
    if not text:
        return [], [], 0
    tree = _utterance().parse(text)
    words, noises, times = [], [], 0
    for n in tree.children:
        if n.rule == PLAIN:
            for w in text[n.start : n.end].lower().split():
                if w.isalpha() or (w := regular_word(w.rstrip(".,!?…"))):
                    words.append(w)
        elif n.rule == SPOKEN:
            if w := regular_word(text[n.start : n.end].rstrip(" .,!?")):
                words.append(w)
        elif n.rule == NOISE:
            inside: list[str] = []
            _names(n, text, inside)
            if inside:
                noises.append(" ".join(inside))
        elif n.rule == TIME:
            times += 1
    return words, noises, times


EVENTS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("participant", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("noise", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("pref", T.LongType()),
        T.StructField("row_id", T.LongType()),
    ]
)


def clean_utterances(df: DataFrame) -> DataFrame:
    """Parse every delivered row: participant letter, spoken words (joined by spaces) and noise.

    Parsing happens before any shuffle. Copies of one (``file``, ``idx``) inside a batch are
    reduced to the preferred one there, so that a much repeated delivery is thinned out at its
    source; ``pref`` orders the rest (named participant first, then rows with content, then the
    smaller ``row_id``). Rows without ``file`` or ``idx`` have no place in any order and are left
    out. Null or empty token lists give no words and no noise. Other columns are not read.
    """

    def parse(batches):
        for b in batches:
            label = b["participant"].map(regular_participant)
            got = [parse_text(t) for t in b["said"]]
            words, noise = [" ".join(w) for w, _, _ in got], [" + ".join(n) for _, n, _ in got]
            out = pd.DataFrame(
                {
                    "file": b["file"],
                    "idx": b["idx"],
                    "participant": label.astype(object).where(label.notna(), None),
                    "words": words,
                    "noise": noise,
                    "start_ms": b["start_ms"],
                    "end_ms": b["end_ms"],
                    "pref": [2 * (p is None) + (not w and not n) for p, w, n in zip(label, words, noise)],
                    "row_id": b["row_id"],
                }
            )
            yield out.sort_values(["file", "idx", "pref", "row_id"], kind="stable").drop_duplicates(["file", "idx"])

    need = df.select("file", F.col("idx").cast("long"), "participant", F.array_join("tokens", " ").alias("said"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), F.col("row_id").cast("long"))
    return need.filter(F.col("file").isNotNull() & F.col("idx").isNotNull()).mapInPandas(parse, EVENTS)


def turn_parts(df: DataFrame) -> DataFrame:
    """Turns in parts: (file, first_idx of the turn, part, participant, idx span, counts, times, text).

    A turn is a longest run, in ``idx`` order, of utterances with at least one spoken word by one
    participant; other rows neither belong to it nor end it. Words of nobody make turns with a
    null participant. A part holds the words of at most one chunk of the file, so that the text of
    an endless monologue never has to fit one row; nearly all turns have one part.
    """
    spoken = clean_utterances(df).filter(F.col("words") != "")
    return with_run_start(pieces(spoken, key=lambda b: b["participant"], text="words"))


def clean_turns(df: DataFrame) -> DataFrame:
    """One row per turn: file, participant, first_idx, last_idx, n_utterances, start_ms, end_ms."""
    return runs(turn_parts(df))
