"""Repeated consecutive utterances and noises (problem 5).

The keys of the run operator: spoken words in their usual spelling, or the noise where there are
no words. Usual spellings come from the whole corpus: a rare form is a slip only where the corpus'
own rate of slips explains how often it occurs, so that words which merely look alike stay apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm import runs as layout
from voxmill.llm.runs import pieces, runs, with_run_start
from voxmill.llm.transcripts import clean_utterances
from voxmill.runtime import Workspace, broadcast_if_small

#: Positions of a file in which several copies of one form count once, since they are copies of one slip.
PLACE = 64
#: Longer words are of one class.
LONGEST = 16
#: Of all words at most this part is taken to be slips; some words are mistyped so many times as often as the
#: average of their class, and some forms as the average of their word; and forms are slips while the rate of
#: slips explains at least this part of their number.
MOST_SLIPS, UNEVEN, UNEVEN_FORMS, EXPLAINED = 0.03, 5.0, 2.0, 0.25
#: A length's own rate of slips counts in full beside so many slips at the rate of all words.
EVIDENCE = 5


def _undone(batches):
    """Each word with every word that one swapped pair of letters or one doubled letter would have made it from."""
    for b in batches:
        out = []
        for w, n in zip(b["word"], b["n"]):
            for i in range(len(w) - 1):
                if w[i] == w[i + 1]:
                    out.append((w, n, w[:i] + w[i + 1 :]))
                else:
                    out.append((w, n, w[:i] + w[i + 1] + w[i] + w[i + 2 :]))
        yield pd.DataFrame(out, columns=["word", "n", "usual"]).drop_duplicates()


def candidates(counts: DataFrame) -> DataFrame:
    """(word, usual, n_usual): words that one swap or doubling makes from a more frequent word, the most frequent one.

    ``counts`` (word, n) has one row per distinct word, over the whole corpus. Candidates come from an
    equi join on the undone slip, not from comparing words with each other.
    """
    tried = counts.mapInPandas(_undone, "word string, n long, usual string")
    usual = counts.select(F.col("word").alias("usual"), F.col("n").alias("n_usual"))
    best = Window.partitionBy("word").orderBy(F.desc("n_usual"), "usual")
    hit = tried.join(usual, "usual").filter(F.col("n_usual") > F.col("n"))
    return hit.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("word", "usual", "n_usual")


def most_places(classes: dict[tuple[int, int], tuple[int, int, int]], seen: dict[tuple[int, int, int], int]) -> dict[tuple[int, int], tuple[int, float, int]]:
    """Per class of usual words: the most places in which a form of theirs may occur and still be a slip, the rate of slips, and the level's forms.

    A class is a level of frequency (powers of two) and a length. ``classes``: class -> (forms that
    slips of its words can have, chances for them, occurrences of its words); a word with 13 forms
    that occurs 10 times gives 130 chances. ``seen``: (level, length, places) -> number of candidate
    forms. At the rate of slips per chance, which is that of the length as far as there is evidence
    and else that of all words, a form is expected in so many places with a geometric tail. Where
    more forms are seen in that many places or more than the rate explains, the most frequent ones
    are words of their own: they are taken out and the rates are estimated again, until all that
    is left is explained. A form never counts as evidence for its own frequency. Forms of a single
    place are judged by level, over all lengths.

    This is coarse: words differ in how often they are mistyped. ``slips`` then holds each form against
    the other forms of its own word.
    """
    left: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (level, length, places), forms in sorted(seen.items()):
        left.setdefault((level, length), []).append((places, forms))
    chances: dict[int, int] = {}
    for (_, length), x in classes.items():
        chances[length] = chances.get(length, 0) + x[1]
    total = sum(chances.values())
    if not total:
        return {}
    ceiling = MOST_SLIPS * sum(x[2] for x in classes.values()) / total

    def rate(length: int, less: int) -> float:
        of = lambda own: sum(n * k for x in own for n, k in left[x])
        overall = min(ceiling, (of(left) - less) / total)
        if not overall:
            return 0.0
        return min(ceiling, (of([x for x in left if x[1] == length]) - less + EVIDENCE) / (chances[length] + EVIDENCE / overall))

    def explained(c: tuple[int, int], n: int, k: int) -> float:
        """Expected number of forms of the class in at least ``n`` places."""
        mean = rate(c[1], (n - 1) * k) * classes[c][1] / classes[c][0]
        m = mean * (UNEVEN if n > 1 else 1.0)
        return classes[c][0] * (m / (1 + m)) ** n

    changed = True
    while changed:
        changed = False
        for c, own in left.items():
            above = 0
            for n, k in reversed(own):
                above += k
                if n > 1 and explained(c, n, k) < EXPLAINED * above:
                    own.pop()
                    changed = True
                    break
    for level in sorted({x[0] for x in left}):
        at = [x for x in left if x[0] == level]
        if sum(explained(c, 1, 0) for c in classes if c[0] == level) < EXPLAINED * sum(k for x in at for _, k in left[x]):
            for x in at:
                left[x] = left[x][1:] if left[x] and left[x][0][0] == 1 and len(left[x]) == 1 else left[x]
    of_level: dict[int, int] = {}
    for (level, _), x in classes.items():
        of_level[level] = of_level.get(level, 0) + x[0]
    return {c: (own[-1][0], rate(c[1], 0), of_level[c[0]]) for c, own in left.items() if own}


def forms_of(word: Column) -> Column:
    """How many forms one swap of unequal neighbours or one doubling can make of a word."""
    return (2 * F.length(F.regexp_replace(word, r"(.)\1+", "$1")) - 1).cast("long")


def _tail(n: Column, mean: Column) -> Column:
    """About the chance of ``n`` or more by a negative binomial distribution of shape 4: chance with some unevenness."""
    p = mean / (4 + mean)
    mass = (n + 1) * (n + 2) * (n + 3) / 6 * F.pow(1 - p, F.lit(4)) * F.pow(p, n)
    return F.when(n <= mean, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mass / (1 - p * (n + 4) / (n + 1))))


def slips(said: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(hits, fixes): ``hits`` are the rows of ``said`` (word, place, ...) that are a candidate, with its usual word;
    ``fixes`` (word, usual) are the candidates that are slips.

    A form that passes ``most_places`` must also be explained by the rate at which its word's other
    forms occur, which counts in full beside one slip at the rate of the class. Only counts by class and number of places come to the driver: at most some thousand numbers.
    """
    counts = ws.save(said.groupBy("word").agg(F.count("*").alias("n")), "counts")
    found = ws.save(candidates(counts), "candidates")
    small = found.count()
    hits = ws.save(said.join(broadcast_if_small(found, small, 200), "word"), "hits")
    level = lambda n: F.floor(F.log2(F.col(n).cast("double"))).cast("int")
    # Beyond 64 places eighths of a power of two are exact enough.
    n = F.count_distinct("place")
    places = hits.groupBy("word", "usual", "n_usual").agg(F.when(n <= 64, n).otherwise(F.floor(F.pow(2.0, F.floor(F.log2(n.cast("double")) * 8) / 8))).cast("long").alias("places"))
    length = lambda w: F.least(F.length(w), F.lit(LONGEST)).cast("int")
    places = ws.save(places.withColumn("level", level("n_usual")).withColumn("length", length("usual")), "places")
    classes = counts.withColumn("forms", forms_of(F.col("word"))).groupBy(level("n").alias("level"), length("word").alias("length")).agg(F.sum("forms"), F.sum(F.col("forms") * F.col("n")), F.sum("n"))
    seen = places.groupBy("level", "length", "places").agg(F.count("*"))
    most = most_places({tuple(r)[:2]: tuple(r)[2:] for r in classes.collect()}, {tuple(r)[:3]: r[3] for r in seen.collect()})
    top = F.broadcast(ws.spark.createDataFrame([(*c, *x) for c, x in most.items()], "level int, length int, top long, rate double, level_forms long"))  # a row per class
    passed = places.join(top, ["level", "length"]).filter("places <= top")
    others = F.sum("places").over(Window.partitionBy("usual")) - F.col("places")  # a word has at most twice its length of forms
    chances = F.greatest(forms_of(F.col("usual")) - 1, F.lit(1)) * F.col("n_usual")
    mean = F.col("n_usual") * (others + 1) / (chances + 1 / F.col("rate"))
    kept = passed.withColumn("_m", mean * UNEVEN_FORMS).filter((F.col("places") == 1) | (F.col("level_forms") * _tail(F.col("places"), F.col("_m")) >= EXPLAINED))
    return hits, kept.select("word", "usual")


def _keys(b: pd.DataFrame) -> pd.Series:
    keys = []
    for p, w, noise, fixes, idx in zip(b["participant"], b["words"], b["noise"], b["fixes"], b["idx"]):
        if w:
            if fixes is not None and len(fixes):
                usual = {f["word"]: f["usual"] for f in fixes}
                w = " ".join(usual.get(x, x) for x in w.split(" "))
            key = f"w {w}"
        else:
            key = f"n {noise}" if noise else f"- {idx}"
        keys.append(f"{p or '-'} {key}")
    return pd.Series(keys, index=b.index, dtype=object)


def repeat_runs(df: DataFrame) -> DataFrame:
    """All runs of one file: file, first_idx, last_idx, participant, run_key, n_events, duration_ms.

    Runs of one are included, so that the result covers every event once. Equal means the same
    participant (nobody is a participant) and the same spoken words in the same order in their
    usual spelling, or, without words, the same noise. A row with neither is a run of its own and
    ends the run before it. ``duration_ms`` is from the earliest known start to the
    latest known end, at least 0; null if the run has no start or no end.
    """
    ws = Workspace(df.sparkSession, "repeats")
    e = ws.save(clean_utterances(df).withColumn("chunk", F.floor(F.col("idx") / layout.CHUNK).cast("long")), "events")
    place = F.xxhash64("file", F.floor(F.col("idx") / PLACE))
    said = e.filter("words <> ''").select("file", "chunk", place.alias("place"), F.explode(F.split("words", " ")).alias("word"))
    hits, fix = slips(said, ws)
    # A chunk's fixes are few and bounded by its words; only chunks with a slip get any.
    fixes = hits.join(fix, ["word", "usual"]).groupBy("file", "chunk").agg(F.collect_set(F.struct("word", "usual")).alias("fixes"))
    keyed = e.join(fixes, ["file", "chunk"], "left")
    r = runs(with_run_start(pieces(keyed, key=_keys)))
    span = F.col("end_ms") - F.col("start_ms")
    return r.withColumn("duration_ms", F.when(span.isNotNull(), F.greatest(span, F.lit(0))))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_runs(spark.read.parquet(f"{sf_dir}/transcripts.parquet")).filter("n_events >= 2").select("file", "first_idx", "last_idx")
