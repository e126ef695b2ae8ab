import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmill.llm import percentiles, sampling, splits
from voxmill.runtime import Workspace

# --- problem 2 ---


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a in root and b in root:
            root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n,m,seed", [(60, 40, 1), (60, 90, 2), (200, 150, 3)])
def test_forest_equals_union_find(spark, n, m, seed):
    rng = random.Random(seed)
    nodes = [f"p{i}" for i in range(n)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)] + [("p0", None), ("p1", "stranger"), ("p2", "p2")]
    f = splits.spanning_forest(spark.createDataFrame([(x, 9) for x in nodes + [None, "p0"]], "node string, root int"), spark.createDataFrame(links, "a string, b string"), Workspace(spark, "t"))
    got = {r["node"]: r["root"] for r in f.roots.collect()}
    want = closure(nodes, [x for x in links if None not in x])
    assert set(got) == set(nodes)
    same = lambda r: {frozenset(k for k in r if r[k] == v) for v in r.values()}
    assert same(got) == same(want)
    assert f.edges.count() == n - len(set(want.values()))  # a forest has no cycle


def test_long_chain_and_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    hub = [("h", f"s{i}") for i in range(300)]
    nodes = sorted({x for e in chain + hub for x in e})
    f = splits.spanning_forest(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(chain + hub, "a string, b string"), Workspace(spark, "t"))
    assert f.roots.select("root").distinct().count() == 2


def test_star_links_are_as_many_as_members(spark):
    g = spark.createDataFrame([("c", "x"), ("c", "y"), ("c", "z"), ("c", "z"), (None, "x"), ("d", None), ("e", "q")], "conv string, s string")
    assert {tuple(r) for r in splits.star_links(g, "conv", "s").collect()} == {("x", "y"), ("x", "z")}


def test_deal_is_close_to_the_shares_and_whole(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", int(rng.paretovariate(1.1))) for i in range(3000)] + [("giant", 4000)]
    df = spark.createDataFrame(rows, "root string, size long")
    got = {r["root"]: r["split"] for r in splits.deal(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)], len(rows)).collect()}
    assert len(got) == len(rows)
    size = dict(rows)
    total = sum(size.values())
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(size[r] for r in got if got[r] == name) / total - share) < 0.02


def test_empty_forest(spark):
    none = spark.createDataFrame([], "a string, b string")
    f = splits.spanning_forest(spark.createDataFrame([], "node string"), none, Workspace(spark, "t"))
    assert f.roots.count() == 0 and f.edges.count() == 0
    assert splits.deal(spark.createDataFrame([], "root string, size long"), [("a", 1.0)], 0).count() == 0


# --- problem 4 ---


def seats_by_hand(cats, total):
    first, rest = [], []
    for i, c in enumerate(cats):
        for r in range(1, c["n"] + 1):
            (first if r <= c["floor"] else rest).append(((r - 0.5) / max(c["target"], sampling.TINY), i))
    take = first + sorted(rest)[: max(0, total - len(first))]
    return [sum(1 for _, j in take if j == i) for i in range(len(cats))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.fixed_dictionaries({"n": st.integers(0, 40), "target": st.sampled_from([0.0, 0.05, 0.1, 0.2, 0.25, 0.5]), "floor": st.integers(0, 6)}), min_size=1, max_size=6), st.integers(0, 120))
def test_seats_equal_the_sorted_priorities(cats, total):
    assert sampling.seats(cats, total) == seats_by_hand(cats, total)


TARGETS = "plan_id int, band string, lo_words int, hi_words int, target_share double, min_rows int, sample_frac double"


def test_sample_meets_targets_or_reports(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 1, 5, 5, 30])) for i in range(5000)] + [(1, None), (7, 1), (9001, 0), (9002, -3), (None, 5)]
    targets = [(1, "s", 1, 2, 0.2, 5, 0.1), (1, "m", 3, 9, 0.5, 5, 0.1), (1, "l", 20, 40, 0.2, 5, 0.1), (1, "none", 50, None, 0.1, 5, 0.1), (2, "all", None, None, 1.0, 0, 0.5)]
    rec = spark.createDataFrame(rows, "utterance_id long, words int").withColumn("band", F.lit("clash")).withColumn("plan_id", F.lit(99))
    drawn, report = sampling.sample_to_targets(rec, spark.createDataFrame(targets, TARGETS))
    r = {(x["plan_id"], x["band"]): x for x in report.collect()}
    assert sum(x["taken"] for k, x in r.items() if k[0] == 1) == 500 and r[2, "all"]["taken"] == 2500
    assert [k for k, x in r.items() if x["short"]] == [(1, "none")] and r[1, "none"]["taken"] == 0
    # The empty band's seats pass to the others in proportion.
    assert abs(r[1, "m"]["taken"] / 500 - 0.5 / 0.9) < 0.01
    got = drawn.filter("plan_id = 1").collect()
    assert len({x["utterance_id"] for x in got}) == len(got) == 500
    bands = spark.createDataFrame(targets, TARGETS)
    assert sampling.violations(drawn, bands, report).count() == 0
    assert {x["band"] for x in sampling.violations(drawn.withColumn("words", F.lit(99)), bands, report).collect()} == {"s", "m", "l"}
    assert sampling.violations(drawn.union(drawn.filter("band = 'm'").limit(1)), bands, report).count() > 0
    again = sampling.sample_to_targets(rec.repartition(7), spark.createDataFrame(targets, TARGETS))[0]
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in drawn.collect()}


def test_sample_of_nothing(spark):
    drawn, report = sampling.sample_to_targets(spark.createDataFrame([], "utterance_id long, words int"), spark.createDataFrame([(1, "s", 1, 2, 0.5, 5, 0.1), (1, "t", None, None, None, None, None)], TARGETS))
    assert drawn.count() == 0 and [(x["available"], x["taken"]) for x in report.collect()] == [(0, 0), (0, 0)]


# --- problem 6 ---


def exact(vals, p):
    vals = sorted(v for v in vals if v is not None and math.isfinite(v))
    return vals[max(1, math.ceil(round(p * len(vals), 6))) - 1] if vals else None


@pytest.mark.parametrize("size,left", [(1, 1), (2, 1 << 15), (50, 5), (3000, 20), (3000, 1 << 15)])
def test_percentiles_are_exact_and_combine_across_days(spark, monkeypatch, size, left):
    monkeypatch.setattr(percentiles, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(percentiles, "RUN_VALUES", 40)
    monkeypatch.setattr(percentiles, "LEFT", left)
    rng = random.Random(size)
    value = lambda: rng.choice([None, math.nan, math.inf, 0.0, 0.0, -5.0, rng.random(), rng.gauss(0, 1e6), 3.0, 3.0])
    days = [[(rng.choice(["hot", "hot", "hot", "x", None]), value()) for _ in range(size)] for _ in range(2)]
    runs = None
    for rows in days:
        df = spark.createDataFrame(rows, "g string, v double").withColumn("vals", F.lit("clash")).repartition(3)
        r = percentiles.sorted_runs(df, {"g": F.col("g"), "all": F.lit("all")}, {"v": F.col("v")})
        runs = r if runs is None else runs.unionByName(r)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["dimension"], r["grp"], r["p"]): r["value"] for r in percentiles.percentiles(runs, probs).collect()}
    both = days[0] + days[1]
    for p in probs:
        for g in ("hot", "x", None):
            assert got.get(("g", g, p)) == exact([v for k, v in both if k == g], p)
        assert got.get(("all", "all", p)) == exact([v for _, v in both], p)


def test_percentiles_of_one_repeated_value_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 2.5)] * 500, "g string, v double")
    got = percentiles.percentiles(percentiles.sorted_runs(df, {"g": F.col("g")}, {"v": F.col("v")}), [0.5]).collect()
    assert [(r["n"], r["value"]) for r in got] == [(500, 2.5)]
    assert percentiles.percentiles(percentiles.sorted_runs(df.limit(0), {"g": F.col("g")}, {"v": F.col("v")}), [0.5]).count() == 0


def test_side_by_side_search_equals_numpy():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.sort(rng.integers(0, 9, n)).astype(float) for n in (0, 1, 7, 30)])
    off = np.cumsum([0, 0, 1, 7, 30])
    for x in (-1.0, 0.0, 4.0, 9.0):
        for side, inclusive in (("left", False), ("right", True)):
            want = [off[i] + np.searchsorted(v[off[i] : off[i + 1]], x, side) for i in range(4)]
            assert percentiles._search(v, off[:-1], off[1:], np.full(4, x), inclusive).tolist() == want


def test_rows_of_one_person_and_conversation_share_a_split(spark, tmp_path):
    rng = random.Random(9)
    known = [f"p{i:07d}" for i in range(40)]
    label = lambda: rng.choice([*known, *known, "p0000999", "guest", None, " P-" + known[3][1:]])
    tables = {
        "speakers": ([(s, known[7] if s == known[5] else None) for s in known], "speaker_id string, same_as string"),
        "utterances": ([(i, label()) for i in range(600)], "row_id long, speaker string"),
        "turns": ([(i, rng.choice([f"c{i // 9}", None]), label()) for i in range(60)], "turn_id long, conv string, speaker string"),
        "mixed": ([(i, rng.choice([f"p0000999-{known[20]}", f"{known[21]}+{known[22]}", known[23], None, "?"])) for i in range(40)], "mixed_id long, speaker_id string"),
        "split_targets": ([("train", 0.6), ("test", 0.4)], "split_name string, share double"),
    }
    for n, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
    got = splits.assign_splits(spark, str(tmp_path)).collect()
    assert len(got) == len({(r["table_name"], r["row_id"]) for r in got}) == 700
    split = {(r["table_name"], r["row_id"]): r["split"] for r in got}
    by: dict = {}
    number = lambda s: "".join(c for c in s or "" if c.isdigit())
    for i, s in tables["utterances"][0]:
        if number(s):
            by.setdefault("p" + number(s).zfill(7), set()).add(split["utterances", i])
    for i, c, s in tables["turns"][0]:
        if c:
            by.setdefault(c, set()).add(split["turns", i])
        if number(s) and "p" + number(s).zfill(7) in known:
            by.setdefault("p" + number(s).zfill(7), set()).add(split["turns", i])
    for i, s in tables["mixed"][0]:
        for k in known:
            if s and k in s:
                by.setdefault(k, set()).add(split["mixed", i])
    assert by[known[5]] == by[known[7]] and by[known[21]] == by[known[22]]
    assert all(len(v) == 1 for v in by.values())
    assert {tuple(r) for r in splits.same_split_pairs(splits.speaker_forest(spark, str(tmp_path), Workspace(spark, "t"))).collect()} >= {(known[5], known[7]), (known[21], known[22])}


def test_too_many_splits_are_refused(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_SPLITS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        splits.assign_splits(spark, "/root/testdata/sf0.001")
