import random
from collections import Counter
from itertools import groupby

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmill.llm import repeats, runs, transcripts
from voxmill.runtime import Workspace

SCHEMA = "row_id long, file string, idx int, participant string, tokens array<string>, start_ms long, end_ms long, chunk string, words int"


def frame(spark, rows):
    """Rows of (file, idx, participant, tokens), with clashing extra columns."""
    return spark.createDataFrame([(i, f, x, p, t, 1000 * (x or 0), 1000 * (x or 0) + 500, "clash", 7) for i, (f, x, p, t) in enumerate(rows)], SCHEMA)


def turns_by_hand(rows):
    seen = {}
    for f, x, p, t in rows:
        if f is not None and x is not None:
            seen.setdefault((f, x), (transcripts.regular_participant(p), transcripts.parse_utterance(t)[0]))
    out = []
    for f, own in groupby(sorted(seen), key=lambda k: k[0]):
        spoken = [(x, seen[f, x][0]) for _, x in own if seen[f, x][1]]
        for p, run in groupby(spoken, key=lambda s: s[1]):
            run = list(run)
            out.append((f, p, run[0][0], run[-1][0]))
    return sorted(out, key=repr)


def got_turns(df):
    return sorted([tuple(r) for r in transcripts.clean_turns(df).select("file", "participant", "first_idx", "last_idx").collect()], key=repr)


def test_turns_skip_rows_without_words(spark):
    rows = [
        ("f", 0, "*A:", ["one"]), ("f", 0, "A", ["one"]), ("f", 2, "B", ["hmm"]), ("f", 3, "spk-a", ["two"]), ("f", 4, None, ["[door", "slams]"]),
        ("f", 7, "[A]", ["three"]), ("f", 9, "Speaker B", ["four"]), (None, 1, "A", ["x"]), ("f", None, "A", ["x"]), ("g", 1, None, ["nobody"]), ("g", 2, "A", None), ("g", 3, "A", []),
    ]
    assert got_turns(frame(spark, rows)) == turns_by_hand(rows) == sorted([("f", "A", 0, 7), ("f", "B", 9, 9), ("g", None, 1, 1)], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_and_runs_over_many_chunks_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(runs, "CHUNK", 5)
    monkeypatch.setattr(runs, "BLOCK", 3)
    rng = random.Random(seed)
    rows = []
    for f in ("a", "b"):
        for x in range(0, 400):
            if rng.random() < 0.9:
                who = rng.choice(["A", "*A:", "a", "B"]) if rng.random() < 0.3 else "A"
                rows += [(f, x, who, rng.choice([["yes"], ["Yes."], ["no"], ["hmm"]]))] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    df = frame(spark, rows)
    assert got_turns(df) == turns_by_hand(rows)
    parts = transcripts.turn_parts(df).groupBy("file", "run_first").agg(F.sum("n_events").alias("n")).agg(F.sum("n")).first()[0]
    assert parts == sum(1 for (f, x) in {(r[0], r[1]) for r in rows} if any(transcripts.parse_utterance(r[3])[0] for r in rows if r[:2] == (f, x)))


def test_repeats(spark):
    said = ["the", "heating", "is", "off"]
    rows = [("f", 0, "A", said), ("f", 3, "*A:", ["The", "hmm", "heating", "is", "off..."]), ("f", 4, "a", [*said, "[00:00:01.000]"]), ("f", 4, "A", said)]
    rows += [("f", 5, "A", ["the", "heating", "is", "on"]), ("f", 6, "B", ["the", "heating", "is", "on"])]
    rows += [("f", 7, None, ["&=door:slams"]), ("f", 8, "", ["[DOOR", "SLAMS]"]), ("f", 9, "B", ["<door_slams>"]), ("f", 10, "B", ["hmm"]), ("f", 11, "B", ["hmm"]), ("f", 12, "B", ["<door_slams>"])]
    rows += [("g", i, "A", ["visitor", str(i)]) for i in range(0, 40, 2)] + [("g", 101, "A", ["visitor", "waits"]), ("g", 102, "A", ["visiotr", "waits"]), ("g", 103, "A", ["visittor", "waits"])]
    r = repeats.repeat_runs(frame(spark, rows))
    got = sorted(tuple(x) for x in r.filter("n_events > 1").select("file", "first_idx", "last_idx", "n_events", "duration_ms").collect())
    # The 20 numbered rows have the same single spoken word, so they are a run too.
    assert got == [("f", 0, 4, 3, 4500), ("f", 7, 8, 2, 1500), ("g", 0, 38, 20, 38500), ("g", 101, 103, 3, 2500)]
    assert r.agg(F.sum("n_events")).first()[0] == len({(a, b) for a, b, *_ in rows})


def slips_of(spark, rows):
    """Slips among (word, place) rows."""
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["word", "place"]))
    return {r["word"]: r["usual"] for r in repeats.slips(df, Workspace(spark, "t"))[1].collect()}


def test_words_of_similar_spelling_that_are_both_in_use_stay_apart(spark):
    counts = [("form", 50), ("from", 90), ("visitor", 100), ("visiotr", 2), ("visittor", 1), ("viistor", 20)]
    rows = [(w, i) for w, n in counts for i in range(n)]
    assert slips_of(spark, rows) == {"visiotr": "visitor", "visittor": "visitor"}
    counts = [("quite", 80), ("quiet", 9), ("trail", 8), ("trial", 1), ("later", 40), ("latter", 4)]
    assert slips_of(spark, [(w, i) for w, n in counts for i in range(n)]) == {}


def test_slips_of_a_vocabulary_that_was_not_looked_at(spark):
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfghklmnprstvz" for b in "aeiou"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3, 3, 4]))) + rng.choice(["", "n", "s"]) for _ in range(600)})
    rng.shuffle(words)

    def mistyped(w):
        i = rng.randrange(len(w) - 1)
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if w[i] != w[i + 1] and rng.random() < 0.5 else w[:i] + w[i] + w[i:]

    alike = {w: x for w in rng.sample([w for w in words if len(w) >= 5], 40) if (x := mistyped(w)) not in words}
    rows, slipped = [], {}
    for k, w in enumerate(rng.choices(words, [1 / (i + 5) for i in range(len(words))], k=200_000)):
        if w in alike and rng.random() < 0.08:
            w = alike[w]
        elif len(w) > 5 and rng.random() < 0.005 and (x := mistyped(w)) not in words and x not in alike.values():
            slipped[x], w = w, x
        rows.append((w, k // 40))
    got = slips_of(spark, rows)
    count = Counter(w for w, _ in rows)
    wrong = sum(count[x] for x in got if slipped.get(x) != got[x])
    lost = sum(count[x] for x in slipped if got.get(x) != slipped[x])
    assert wrong <= 0.01 * sum(count[x] for x in alike.values()) and lost <= 0.01 * sum(count[x] for x in slipped)


def test_empty_table_and_null_times(spark):
    empty = frame(spark, [])
    assert transcripts.clean_turns(empty).count() == 0 and repeats.repeat_runs(empty).count() == 0
    df = frame(spark, [("f", 0, "A", ["x"]), ("f", 1, "A", ["x"])]).withColumn("start_ms", F.lit(None).cast("long")).withColumn("end_ms", F.lit(None).cast("long"))
    assert [tuple(x) for x in repeats.repeat_runs(df).select("n_events", "duration_ms").collect()] == [(2, None)]


def test_hot_copies_of_one_row(spark):
    rows = [("f", 0, "A", ["x"])] * 3000 + [("f", 1, "B", ["y"])]
    assert got_turns(frame(spark, rows)) == [("f", "A", 0, 0), ("f", "B", 1, 1)]
