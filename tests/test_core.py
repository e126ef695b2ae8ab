import math
import posixpath
import random
import urllib.parse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmill.functions import ids, kernels, paths
from voxmill.functions import signal as S
from voxmill.functions import text as X
from voxmill.operators import audit, conversations, matching, packing, scene, stats
from voxmill.operators.ordering import hashed_rank, sorted_rank
from voxmill.plans import reference_queries
from voxmill.sources import flac, text_files, wav
from voxmill.streaming import compactor


def one(spark, col, **cols):
    row = spark.range(1)
    for k, (v, t) in cols.items():
        row = row.withColumn(k, F.lit(v).cast(t))
    return row.select(col.alias("x")).first()["x"]


def col(values):
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


# --- text, ids, paths ---


@pytest.mark.parametrize(
    "tokens,want",
    [(["Hello", "&=laughs", "foo@bar", "xxx", "+ing", "...", "WORLD!", None], ["hello", "world"]), (["xxx.", "XXX", "'2'", "été", "'"], ["xxx", "xxx", "''", "t"]), ([], [])],
)
def test_transcript_tokens(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    assert df.select(X.clean_transcript_tokens(F.col("tokens"))).first()[0] == want


def test_clean_text(spark):
    df = spark.createDataFrame([("Hello, world! ... it's 2026 -- great.",), (None,), (" \t",), ("a\u2003b\x85c",)], "t string")
    assert [r[0] for r in df.select(X.clean_words(F.col("t"))).collect()] == [["hello", "world", "it's", "great"], [], [], ["a", "b", "c"]]
    assert [r[0] for r in df.select(X.word_count(F.col("t"))).collect()] == [7, 0, 0, 3]
    assert spark.range(1).select(X.stripped(F.lit("\u2003 x y \n"))).first()[0] == "x y"


def test_speaker_labels(spark):
    rows = ["p0001004", "P-0001004", " p0001004", "p1004", "spk_p0001004", "speaker p0001004", "p0001004:", "p０００１００４", "Ｐ-１００４", "p٠٠٠١٠٠٤", None, "", "?", "guest", "p123456789"]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    assert [r[0] for r in df.select(ids.regular_speaker(F.col("s"))).collect()] == ["p0001004"] * 10 + [None] * 4 + ["p123456789"]
    both = spark.createDataFrame([("p0001-P-2",), ("p0000001 + spk_p1",), ("p００００００１-p0000002",), (None,), ("x",)], "s string").select(ids.named_speakers(F.col("s"))).collect()
    assert [r[0] for r in both] == [["p0000001", "p0000002"], ["p0000001"], ["p0000001", "p0000002"], [], []]


def canonical(p):
    if p is None or not p.strip():
        return None
    p = p.strip().replace("\\", "/")
    if p.lower().startswith("file:"):
        p = p[5:]
        p = p[2:] if p.startswith("///") else p
    p = urllib.parse.unquote(p)
    return posixpath.normpath(p if p.startswith("/") else "/srv/speech/" + p).replace("//", "/")


def test_paths_equal_posix_rules(spark):
    steps = ["a", "b%5Fc", "..", ".", "", "D", "x y"]
    rng = random.Random(1)
    rows = ["/".join(rng.choice(steps) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    rows = [rng.choice(["", "/", "file:///", "\\", " /"]) + r for r in rows] + [None, "", "  ", "/a/b.txt\t", "/a+b", "file:///srv/%6Dic", "\\srv\\speech\\x"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    for r, got in zip(rows, df.select(paths.canonical_path(F.col("p"))).collect()):
        assert got[0] == canonical(r), r


def test_hashed_rank_equals_a_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), i, rng.randrange(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    h = F.xxhash64("i")
    got = {(r["k"], r["i"]): (r["rank"], r["before"]) for r in hashed_rank(df, ["k"], h, ["i"], len(rows), weight="w", bucket_rows=50).collect()}
    hashes = {r["i"]: r["h"] for r in df.select("i", h.alias("h")).collect()}
    for key in ("hot", "x", None):
        own = sorted([r for r in rows if r[0] == key], key=lambda r: (hashes[r[1]], r[1]))
        before = 0
        for n, r in enumerate(own, 1):
            assert got[key, r[1]] == (n, before)
            before += r[2]


def test_sorted_rank_and_pairs(spark):
    rows = [f"s{i * 37 % 1001:04d}" for i in range(1001)]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = {r["s"]: r["rank"] for r in sorted_rank(df, ["s"]).collect()}
    assert got == {s: i for i, s in enumerate(sorted(rows))}
    pairs = {tuple(r) for r in conversations.speaker_pairs(df.union(df).union(spark.createDataFrame([(None,)], "s string")), "s").collect()}
    assert pairs == {(i, *sorted(rows)[2 * i : 2 * i + 2]) for i in range(500)}


@pytest.mark.parametrize("size", [3, 7, 4096])
def test_turn_runs_across_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(stats, "CHUNK", size)
    rng = random.Random(size)
    rows = [(f, i, rng.choice(["A", "A", "A", "B", None]), rng.choice([0, 1, 2])) for f in ("x", None) for i in rng.sample(range(300), 150)]
    want = []
    for f in ("x", None):
        n, last = 0, object()
        for _, i, who, words in sorted((r for r in rows if r[0] == f), key=lambda r: r[1]):
            if words and who != last:
                n, last = n + 1, who
                want.append([f, n, who, 0])
            if words:
                want[-1][3] += words
    df = spark.createDataFrame(rows, "file string, idx int, who string, words int")
    runs = stats.turn_runs(df, "file", "who", F.col("words"), ["idx"])
    assert sorted([list(r) for r in runs.collect()], key=repr) == sorted(want, key=repr)
    got = {(r["file"], r["i"]): (r["mean"], r["std"]) for r in stats.running(runs, ["file"], "run", "n_words", 20).collect()}
    for f in ("x", None):
        n = [w[3] for w in want if w[0] == f]
        for i in {*range(20, len(n) + 1, 20), len(n)}:
            assert np.allclose(got.pop((f, i)), (np.mean(n[:i]), np.std(n[:i])), atol=1e-6)
    assert not got


def test_faults_are_found(spark):
    e = spark.createDataFrame([(u, 100 * u + i, 3.0 + i % 9) for u in range(4) for i in range(60)], "user_id long, event_id long, value double")
    packed = packing.pack(e, "user_id", "event_id", "value")
    assert packing.broken(packed, e, "user_id", "event_id", "value").count() == 0
    assert packing.broken(packed.filter("item <> 105"), e, "user_id", "event_id", "value").count() >= 1
    built = conversations.build(e, conversations.speaker_pairs(e, "user_id"), "user_id", "event_id", "value")
    assert built.count() > 0 and conversations.broken(built, e, "user_id", "event_id", "value").count() == 0
    assert conversations.broken(built.withColumn("total_s", F.lit(61.0)), e, "user_id", "event_id", "value").filter("fault = 'length'").count() > 0
    assert conversations.broken(built.withColumn("speaker", F.lit(1)), e, "user_id", "event_id", "value").filter("fault = 'turns'").count() > 0
    u = e.withColumn("n", F.lit(5))
    groups = matching.match(u, [9, 10], "user_id", "event_id", "n")
    assert matching.broken(groups, u, "user_id", "event_id", "n").count() == 0
    assert {r["n"] for r in matching.broken(groups.union(groups.limit(1)), u, "user_id", "event_id", "n").collect()} == {2}


# --- compaction ---

FILES = "file_id long, speaker_id string, flac_path string, txt_path string, n_bytes long, content string, batch string, file_key string"


def listing(spark, at, rows, mode="append"):
    spark.createDataFrame([(i, "s", a, t, None, c, "clash", "clash") for i, a, t, c in rows], FILES).coalesce(1).write.mode(mode).parquet(at)


def test_compaction_once_and_again(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    listing(spark, src, [(1, "/srv/speech/a", None, "x"), (2, "a", "t", None), (3, None, "t", "y"), (4, None, "/srv/speech/t", "y"), (5, None, None, "z"), (6, None, None, "z"), (7, "A", None, "w")])
    c = compactor.compact(spark, src, out, bytes_per_batch=1)
    assert c.members.count() == 7 and c.records.count() == 5
    assert {tuple(r) for r in compactor.same_file_pairs(c.members).collect()} == {(1, 2), (3, 4)}
    listing(spark, src, [(8, "file:///srv/speech/a", None, "x"), (9, "/srv/speech/new", None, "n")])
    c = compactor.compact(spark, src, out, bytes_per_batch=1)
    assert c.members.count() == 9 and c.records.count() == 6
    assert c.records.select("file_key").distinct().count() == 6
    again = compactor.compact(spark, src, out)
    assert again.members.count() == 9 and again.records.count() == 6


def test_a_retried_batch_replaces_its_output(spark, tmp_path):
    import shutil

    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    listing(spark, src, [(i, f"/f{i}", None, "x") for i in range(50)])
    want = compactor.compact(spark, src, out).records.count()
    shutil.rmtree(tmp_path / "out" / "checkpoint" / "commits")  # as if the driver died before the commit
    c = compactor.compact(spark, src, out)
    assert c.records.count() == want == 50 and c.members.count() == 50


def test_content_in_a_later_batch_replaces_a_stored_null(spark, tmp_path):
    import shutil

    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stored = lambda c: sorted((r["file_key"], r["file_id"], r["content"]) for r in c.records.collect())
    listing(spark, src, [(1, "/a", None, None), (2, "/b", None, "b"), (3, "/c", None, None)])
    assert [r[1] for r in stored(compactor.compact(spark, src, out))] == [1, 2, 3]
    listing(spark, src, [(4, "/a", None, "a"), (5, "/a", None, "a"), (6, "/b", None, "other"), (7, "/c", None, None)])
    want = [("a:/a", 4, "a"), ("a:/b", 2, "b"), ("a:/c", 3, None)]
    assert stored(compactor.compact(spark, src, out)) == want
    shutil.rmtree(tmp_path / "out" / "checkpoint" / "commits")  # the last batch runs again
    assert stored(compactor.compact(spark, src, out)) == want
    listing(spark, src, [(8, "/a", None, "late"), (9, "/c", None, "c"), (10, "/b", None, None)])
    c = compactor.compact(spark, src, out)
    assert stored(c) == [*want[:2], ("a:/c", 9, "c")] and c.members.count() == 10
    assert set(c.members.columns) == {"file_id", "file_key", "batch"}


def test_many_small_arrivals_make_few_files(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rng, want, n = random.Random(4), {}, 0
    for arrival in range(5):
        for _ in range(4):  # four input files an arrival, a batch each
            rows = []
            for _ in range(30):
                n += 1
                key, content = f"/f{rng.randrange(120)}", rng.choice([None, "x" * rng.randrange(1, 400)])
                rows.append((n, key, None, content))
            listing(spark, src, rows)
        c = compactor.compact(spark, src, out, bytes_per_batch=1, target_bytes=16_000)
    listed = spark.read.parquet(src).select("file_id", "flac_path", "content").collect()
    for r in listed:
        want.setdefault(f"a:{r['flac_path']}", []).append(r["content"])
    stored = c.records.collect()
    assert len(stored) == len({r["file_key"] for r in stored}) == len(want) and c.members.count() == n == 600
    assert all(r["content"] in want[r["file_key"]] and (r["content"] is not None or not any(want[r["file_key"]])) for r in stored)
    files = [f for b in {r["batch"] for r in stored} for f in (tmp_path / "out" / "records" / f"batch={b}").glob("*.parquet")]
    total = sum(r["stored_bytes"] for r in stored)
    assert len(files) <= -(-total // 8_000) + 1
    # All but what the last batch took over is deleted.
    assert len(list((tmp_path / "out" / "records").glob("batch=*"))) <= len({r["batch"] for r in stored}) + 2
    assert sum(r["n_listed"] for r in compactor.classes(c.members).collect()) == 600


def test_compaction_of_an_empty_listing(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    listing(spark, src, [])
    c = compactor.compact(spark, src, f"file://{tmp_path}/out")
    assert c.records.count() == 0 and c.members.count() == 0


# --- signals ---


def tone(f, fs, s, a=0.5):
    return a * np.sin(2 * np.pi * f * np.arange(int(fs * s)) / fs)


def test_levels():
    assert kernels.level_db(tone(50, 48000, 1), 48000) < kernels.level_db(tone(1000, 48000, 1), 48000)
    assert kernels.level_db(np.zeros(16000), 16000) < -200
    x = tone(1000, 48000, 0.5, 0.3)
    assert abs(kernels.level_db(np.stack([x, x]), 48000) - kernels.level_db(x, 48000)) < 1e-9
    assert math.isnan(kernels.level_db(np.zeros(0), 48000))


def test_level_of_short_arrays_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    for n in (1, 5, 64):
        x = rng.normal(0, 0.3, n)
        assert abs(one(spark, S.level_db(col(x), 16000)) - kernels.level_db(x, 16000)) < 1e-6


def test_normalising_and_clipping():
    x = tone(1000, 16000, 1, 0.9)
    base = kernels.level_db(x, 16000)
    assert abs(kernels.level_db(kernels.normalized(x, 16000, base - 10), 16000) - base + 10) < 0.1
    assert abs(np.abs(kernels.normalized(tone(1000, 16000, 1, 0.1), 16000, kernels.level_db(tone(1000, 16000, 1, 0.1), 16000) + 40)).max() - 1) < 1e-9


def test_pad_fade_fit_tile(spark):
    assert one(spark, S.padded(col([1] * 5), 10)) == [0.0, 0.0, 1, 1, 1, 1, 1, 0.0, 0.0, 0.0]
    assert one(spark, S.padded(col([1] * 5), 3)) == [1.0] * 5 and one(spark, S.fitted(col([1, 2, 3]), 2)) == [1.0, 2.0]
    f = one(spark, S.faded(col([1] * 200), 1000, 0.01))
    assert f[0] == f[-1] == 0 and f[100] == 1 and f[:10] == sorted(f[:10])
    assert one(spark, S.faded(col([1]), 1000)) == [1.0]
    assert one(spark, S.tiled_average(col([1, 3]), col([1, 1, 1]))) == [1.0, 2.0, 1.0]
    assert len(one(spark, S.silence(16000, 0.1))) == 1600
    assert one(spark, S.mono(F.array(col([1, 2]), col([3, 4])))) == [2.0, 3.0]


def test_activity(spark):
    x = np.concatenate([tone(440, 16000, 0.25), np.zeros(4000)])
    assert kernels.activity(x, 16000).tolist() == [1] * 5 + [0] * 5
    assert kernels.activity(np.zeros(1600), 16000).tolist() == [0, 0]
    assert one(spark, S.activity(col([0.5, -0.5, 0, 0, 0.4]), 2)) == [1, 0, 1]
    with pytest.raises(ValueError):
        kernels.activity(x, 1)


@pytest.mark.parametrize("ebr", scene.EBRS)
@pytest.mark.parametrize("sar", scene.SARS)
def test_mixing_and_its_audit(ebr, sar):
    rng = np.random.default_rng(0)
    speech, events, bg = (rng.normal(0, s, 16000) for s in (0.2, 0.05, 0.01))
    y = kernels.mix_scene(speech, events, bg, 16000, scene.EBRS[ebr], scene.SARS[sar])
    assert y.shape == speech.shape and np.isfinite(y).all()
    assert abs(kernels.level_db(speech, 16000) - kernels.level_db(y - speech, 16000) - scene.SARS[sar]) < 0.05


def test_locate_and_fit():
    rng = np.random.default_rng(1)
    src = rng.normal(size=5000)
    assert kernels.locate(src[1234:1734] * -0.3, src)[0] == 1234 and kernels.locate(src[:10], src)[1] > 0
    assert kernels.locate(src, src[:10]) == (None, 0.0) and kernels.locate(np.zeros(5), src) == (None, 0.0)
    a, b = rng.normal(size=(2, 300)), rng.normal(size=(2, 300))
    ca, cb, r2, gain = kernels.fit_two(2 * a - 0.5 * b, a, b)
    assert np.allclose([ca, cb, r2], [2, -0.5, 1]) and gain > 0.5


def test_room():
    h = kernels.room_response(8000)
    assert h.shape[0] == 2 and np.isfinite(h).all() and np.allclose(h[0], h[1])
    assert not np.allclose(*kernels.room_response(8000, 0.5))
    assert kernels.in_room(tone(440, 8000, 0.05, 0.8), 8000).shape[0] == 2


def test_resampling_keeps_a_tone():
    y = kernels.resampled(tone(440, 48000, 0.2), 48000, 16000)
    assert len(y) == 3200 and np.abs(y - tone(440, 16000, 0.2))[100:-100].max() < 1e-2


def test_render_then_audit(spark):
    rng = np.random.default_rng(5)
    fs = 8000
    ev, bg = rng.normal(0, 0.1, (2, 3 * fs)), rng.normal(0, 0.02, (2, 4 * fs))
    seg = spark.createDataFrame([("s1", "p1", tone(440, fs, 0.7).tolist()), ("s2", "p2", tone(300, fs, 2).tolist()), ("s3", "p3", None)], "stem string, speaker_id string, samples array<double>")
    out = scene.render(seg, ev, bg, fs, 1.0).withColumn("mixed_id", F.monotonically_increasing_id()).cache()
    assert out.count() == 20
    kept = out.filter("not (stem = 's2' and ebr = 'low' and sar = 'mid')")
    c = audit.checks(kept)
    assert sorted(r[0] for r in c.groupBy("status").count().collect()) == ["CHECKED", "MISSING"]
    heard = audit.with_audio(c, kept)
    long = audit.long_checks(heard, ev, bg).collect()
    assert len(long) == 17 and all(r["sar_pass"] for r in long) and all(r["ebr_pass"] in (True, None) for r in long)
    assert any(r["ebr_pass"] for r in long)
    assert tuple(audit.totals(c.join(audit.long_checks(heard, ev, bg).select("stem", "ebr", "sar", "sar_pass", "ebr_pass"), ["stem", "ebr", "sar"], "left")).first()) == (18, 1)
    with pytest.raises(ValueError):
        scene.render(seg, ev[:, :10], bg, fs, 1.0)


def test_levels_are_audited_at_any_rate(spark, tmp_path):
    x = tone(300, 8000, 0.05)
    rows, n = [], 0
    for rate in (8000, 22050, 0):
        for e, s in [("none", "none"), *((e, s) for e in scene.EBRS for s in scene.SARS)]:
            n += 1
            rows.append((n, f"s{rate}", e, s, rate, [(x if e == "none" else 2 * x).tolist()] * 2))
    spark.createDataFrame(rows, "mixed_id long, stem string, ebr string, sar string, sr int, channels array<array<double>>").write.parquet(f"{tmp_path}/mixed.parquet")
    got = reference_queries.audit_levels(spark, str(tmp_path)).collect()
    assert {(r["stem"], r["sar"], r["sar_pass"]) for r in got} == {(f"s{fs}", k, (v == 0) if fs else None) for fs in (8000, 22050, 0) for k, v in scene.SARS.items()} and len(got) == 27
    assert tuple(reference_queries.audit_totals(spark, str(tmp_path)).first()) == (27, 12)


# --- packing, matching, conversations ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.1, 44.9), max_size=60))
def test_first_fit_invariants(durations):
    out = packing.first_fit(durations)
    assert sorted(i for b in out for i in b) == list(range(len(durations)))
    for b in out:
        assert b == sorted(b) and sum(durations[i] for i in b) + 0.1 * (len(b) - 1) <= 60 + 1e-6


def scanned_first_fit(durations):
    left, out = list(range(len(durations))), []
    while left:
        length, taken, skipped = 0.0, [], []
        for i in left:
            if length + (durations[i] + 0.1 if taken else durations[i]) <= 60:
                length = (length + 0.1 if taken else length) + durations[i]
                taken.append(i)
            else:
                skipped.append(i)
        if not taken:
            taken, skipped = [left[0]], left[1:]
        out.append(taken)
        left = skipped
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.floats(0.1, 70), st.sampled_from([0.1, 14.9, 19.9, 29.95, 59.9, 60.0])), max_size=80))
def test_first_fit_equals_the_plain_scan(durations):
    assert packing.first_fit(durations) == scanned_first_fit(durations)


def test_a_large_pool_is_packed_as_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_POOL", 7, raising=False)
    rng = random.Random(2)
    d = [rng.uniform(1, 44) for _ in range(100)]
    got = packing.pack(spark.createDataFrame([("a", i, x) for i, x in enumerate(d)], "s string, i long, d double"), "s", "i", "d").collect()
    bufs = {}
    for r in sorted(got, key=lambda r: (r["pool"], r["buf"], r["pos"])):
        bufs.setdefault((r["pool"], r["buf"]), []).append(r["item"])
    assert list(bufs.values()) == scanned_first_fit(d)


def test_conversations_use_the_whole_larger_pool(spark, monkeypatch):
    monkeypatch.setattr(conversations, "MAX_POOL", 20, raising=False)
    rows = [("a", i, 10.0) for i in range(60)] + [("b", 100 + i, 10.0) for i in range(20)]
    items = spark.createDataFrame(rows, "s string, i long, d double")
    got = conversations.build(items, conversations.speaker_pairs(items, "s"), "s", "i", "d").collect()
    assert max(r["item"] for r in got if r["speaker"] == "a") >= 20
    assert len({r["item"] for r in got}) == len(got)


def test_dropping_from_a_pool():
    p = conversations.Pool([("a", i % 7, float(i)) for i in range(20)])
    for i in (6, 0, 3, 9):
        p.drop(i)
    assert sorted(x[2] for x in p.items) == [float(i) for i in range(20) if i % 7 not in (6, 0, 3)]
    assert all(p.items[k][1] == i for i, at in p.at.items() for k in at) and sum(map(len, p.at.values())) == len(p.items)


def test_pack_frame(spark):
    rows = [("a", i, d) for i, d in enumerate([20.0, 20.0, 19.7, 44.0, 45.0, None, math.nan, 0.0, 30.0])]
    got = packing.pack(spark.createDataFrame(rows, "s string, i long, d double"), "s", "i", "d").collect()
    assert sorted((r["buf"], r["pos"], r["item"], r["kept"]) for r in got) == [(0, 0, 0, True), (0, 1, 1, True), (0, 2, 2, True), (1, 0, 3, False), (2, 0, 8, False)]
    assert packing.pack(spark.createDataFrame([], "s string, i long, d double"), "s", "i", "d").count() == 0


def test_matching_uses_every_utterance_once(spark):
    rows = [(f"s{s}", i + 100 * s, i % 5 + 1) for s in range(3) for i in range(10)]
    got = matching.match(spark.createDataFrame(rows, "s string, i long, n int"), [2, 4, 6, 8, 10, 3, 5, 7], "s", "i", "n").collect()
    assert sorted(r["item"] for r in got) == sorted(r[1] for r in rows)
    groups = {}
    for r in got:
        groups.setdefault((r["speaker"], r["group_no"]), []).append(r)
    assert all(len({r["item"] // 100 for r in g}) == 1 for g in groups.values())
    again = matching.match(spark.createDataFrame(rows[::-1], "s string, i long, n int"), [2, 4, 6, 8, 10, 3, 5, 7], "s", "i", "n").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


def test_matching_draws_targets_by_their_frequency(spark):
    items = spark.createDataFrame([("s", i, 1) for i in range(3000)], "s string, i long, n int")
    got = matching.match(items, {1: 900, 3: 99, 250: 1}, "s", "i", "n").groupBy("group_no").agg(F.first("target").alias("t")).groupBy("t").count().collect()
    n = {r["t"]: r["count"] for r in got}
    assert 6 * n[3] < n[1] < 14 * n[3]


def test_matching_keeps_utterances_of_no_known_speaker_alone(spark):
    rows = [(None, i, 2) for i in range(40)] + [("s", 100 + i, 2) for i in range(10)]
    got = matching.match(spark.createDataFrame(rows, "s string, i long, n int"), {4: 1}, "s", "i", "n").collect()
    assert sorted(r["item"] for r in got) == sorted(r[1] for r in rows)
    alone = [r for r in got if r["speaker"] is None]
    assert len({(r["part"], r["group_no"]) for r in alone}) == 40 and all(r["target"] is None for r in alone)


def test_match_groups_aims_at_the_observed_turns(spark, tmp_path):
    def tokens(n):
        return ["w"] * n

    calls = [("f", i, i, "AB"[i % 2], tokens(250 if i == 99 else 2)) for i in range(100)]
    spark.createDataFrame(calls, "file string, row_id long, idx long, participant string, tokens array<string>").write.parquet(f"{tmp_path}/transcripts.parquet")
    said = [("s", i, f"/s_{i}_mic1.flac", "a") for i in range(2000)]
    spark.createDataFrame(said, "speaker string, row_id long, path string, text string").write.parquet(f"{tmp_path}/utterances.parquet")
    targets = [r["target"] for r in reference_queries.match_groups(spark, str(tmp_path)).filter("pos = 0").collect()]
    assert 250 in targets and targets.count(2) > 0.9 * len(targets)


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(s, 1000 * s + i, rng.uniform(2, 25)) for s in range(5) for i in range(30)]
    items = spark.createDataFrame(rows, "s long, i long, d double")
    pairs = conversations.speaker_pairs(items, "s")
    assert [(r["a"], r["b"]) for r in pairs.orderBy("pair_no").collect()] == [(0, 1), (2, 3)]
    got = conversations.build(items, pairs, "s", "i", "d").collect()
    convs = {}
    for r in got:
        convs.setdefault((r["pair_no"], r["conv"]), []).append(r)
    assert convs and len({r["item"] for r in got}) == len(got)
    for turns in convs.values():
        turns.sort(key=lambda r: r["turn"])
        total = sum(r["dur"] for r in turns) + 0.5 * (len(turns) - 1)
        assert 48 <= total <= 60 and len(turns) >= 3 and all(r["dur"] <= 20 for r in turns)
        assert all(a["speaker"] != b["speaker"] for a, b in zip(turns, turns[1:])) and turns[0]["speaker"] < turns[1]["speaker"]


def test_summary_of_nothing(spark):
    r = stats.summary(spark.createDataFrame([], "n long"), "n").first()
    assert r["n"] == 0 and r["mean"] is None


# --- sources ---


def test_wav_round_trip(spark, tmp_path):
    x = np.stack([tone(440, 8000, 0.1), tone(220, 8000, 0.1)])
    df = spark.createDataFrame([("a/x.wav", 8000, x.tolist())], "name string, sr int, channels array<array<double>>")
    assert wav.write_audio(df, str(tmp_path)).count() == 1
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in wav.read_audio(spark, str(tmp_path)).collect()}
    assert rows["x.wav"]["sr"] == 8000 and rows["x.wav"]["n_channels"] == 2 and np.abs(np.array(rows["x.wav"]["channels"]) - x).max() < 1 / 32768
    assert rows["bad.wav"]["error"] and rows["bad.wav"]["sr"] is None


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3), st.integers(0, 9000), st.sampled_from([0.0, 0.001, 0.3, 2.0]))
def test_flac_round_trip(channels, n, loud):
    x = np.random.default_rng(n).normal(0, loud, (channels, n))
    x[:, n // 2 :] = 0
    data = flac.encode(x, 44100)
    y, rate = flac.decode(data)
    assert rate == 44100 and y.shape == x.shape and np.array_equal(y, np.clip(np.round(x * 32768), -32768, 32767) / 32768)
    assert wav.HEADERS["flac"](data[:42]) == (44100, channels, n) == wav.HEADERS["wav"](wav.encode_wav(x, 44100))


def test_flac_predictors():
    rng = np.random.default_rng(2)
    for order in range(5):
        x = rng.integers(-1000, 1000, 50)
        assert np.array_equal(flac._integrated(x[:order], np.diff(x, order), order), x)
    weights, shift = [3, -2, 5], 2  # newest sample last
    x = [4, 5, 6]
    for e in rng.integers(-9, 9, 40).tolist():
        x.append(e + (sum(w * v for w, v in zip(weights, x[-3:])) >> shift) % 1000)
    rest = [x[i] - (sum(w * v for w, v in zip(weights, x[i - 3 : i])) >> shift) for i in range(3, len(x))]
    assert flac._predicted(x[:3], rest, weights, shift).tolist() == x


def test_damaged_flac_is_refused():
    data = bytearray(flac.encode(np.random.default_rng(1).normal(0, 0.1, (1, 5000)), 8000))
    data[200] ^= 4
    with pytest.raises(ValueError):
        flac.decode(bytes(data))
    with pytest.raises(ValueError):
        flac.decode(bytes(data[:150]))


def test_headers_only(spark, tmp_path):
    x = np.stack([tone(440, 8000, 0.1), tone(220, 8000, 0.1)])
    (tmp_path / "a.flac").write_bytes(flac.encode(x, 8000))
    (tmp_path / "b.wav").write_bytes(wav.encode_wav(x, 8000))
    (tmp_path / "c.flac").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in wav.read_audio(spark, str(tmp_path), samples=False).collect()}
    assert all((rows[n]["sr"], rows[n]["n_channels"], rows[n]["n_samples"], rows[n]["channels"]) == (8000, 2, 800, None) for n in ("a.flac", "b.wav")) and rows["c.flac"]["error"]
    full = {r["path"].rsplit("/", 1)[-1]: r for r in wav.read_audio(spark, str(tmp_path)).collect()}
    assert full["a.flac"]["channels"] == full["b.wav"]["channels"] and full["a.flac"]["duration"] == 0.1


def test_manifests_and_chat(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"audio_filepath": "wav/12_x/a.flac", "duration": "8.5", "k": 1}\n\n{"audio_filepath": "wav/13_x/b.flac", "duration": 20}\nnothing\n')
    got = text_files.read_manifests(spark, [f"{tmp_path}/m.json"], "/root/d", 8, 10).collect()
    assert [(r["audio_filepath"], r["duration"], r["speaker_id"]) for r in got] == [("/root/d/wav/12_x/a.flac", 8.5, "12")]
    (tmp_path / "c.cha").write_text("@Begin\n*A:\thello there\n\tfriend .\n%mor:\tx\n\ty\n*B:\tyes .\n")
    chat = text_files.read_chat(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["participant"], r["tokens"]) for r in chat] == [("A", ["hello", "there", "friend", "."]), ("B", ["yes", "."])]
