import math
import subprocess
import sys

import numpy as np
import pytest

from voxmill import cli
from voxmill.plans import jobs
from voxmill.sources import flac, wav

COMMANDS = ["monospeaker-reformat", "multispeaker-lengths", "multispeaker-group", "multispeaker-conversations", "mix", "vad", "office-level", "check-integrity", "check-integrity-old"]


def test_help_lists_all_commands():
    out = subprocess.run([sys.executable, "-m", "voxmill", "--help"], capture_output=True, text=True, timeout=30)
    assert out.returncode == 0 and all(c in out.stdout for c in COMMANDS)


@pytest.mark.parametrize("command", COMMANDS)
def test_each_command_has_help(command, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main([command, "--help"])
    assert e.value.code == 0


@pytest.mark.parametrize("argv", [[], ["mix"], ["nothing"]])
def test_wrong_calls_fail(argv, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(argv)
    assert e.value.code != 0


FS = 2000


def tone(f, seconds):
    return 0.4 * np.sin(2 * math.pi * f * np.arange(int(FS * seconds)) / FS)


def corpus(root, speakers=("p1", "p2"), n=8, seconds=9.0):
    for s in speakers:
        for d in (f"{jobs.AUDIO_DIR}/{s}", f"{jobs.TEXT_DIR}/{s}"):
            (root / d).mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (root / f"{jobs.AUDIO_DIR}/{s}/{s}_{i:03d}_mic1.wav").write_bytes(wav.encode_wav(tone(200 + 10 * i, seconds), FS))
            (root / f"{jobs.TEXT_DIR}/{s}/{s}_{i:03d}.txt").write_text(f"words number {'x' * (i + 1)} here\n")


def test_from_corpus_to_audit(spark, tmp_path, capsys):
    corpus(tmp_path / "c")
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "a.cha").write_text("*A:\tone two three four .\n*B:\tfive six seven .\n*A:\teight nine ten eleven twelve .\n")
    c, out = str(tmp_path / "c"), str(tmp_path / "packed")
    jobs.monospeaker_reformat(spark, c, out)
    packed = wav.read_audio(spark, f"{out}/{jobs.AUDIO_DIR}").collect()
    assert len(packed) == 2 and all(r["duration"] == 60.0 for r in packed)
    jobs.multispeaker_lengths(spark, str(tmp_path / "calls"), c, str(tmp_path / "data"))
    assert spark.read.parquet(f"{tmp_path}/data/groups.parquet").count() == 16
    before = (tmp_path / "data" / "groups.parquet" / "_SUCCESS").stat().st_mtime_ns
    jobs.multispeaker_lengths(spark, "/nowhere", c, str(tmp_path / "data"))  # all tables are there already
    assert (tmp_path / "data" / "groups.parquet" / "_SUCCESS").stat().st_mtime_ns == before
    (tmp_path / "c" / "speaker-info.txt").write_text("p1 f\n")
    (tmp_path / "c" / "notes" / "deep").mkdir(parents=True)
    (tmp_path / "c" / "notes" / "deep" / "n.md").write_text("kept")
    for f in (f"{jobs.AUDIO_DIR}/p1/p1_000_mic1.wav", f"{jobs.TEXT_DIR}/p2/p2_001.txt"):
        (tmp_path / "c" / f).rename(tmp_path / "away")
        (tmp_path / "c" / f).with_suffix(".away").write_bytes((tmp_path / "away").read_bytes())
    jobs.multispeaker_group(spark, f"{tmp_path}/data/groups.parquet", c, str(tmp_path / "groups"))
    assert "1 items without audio, 1 without a transcript" in capsys.readouterr().out
    assert (tmp_path / "groups" / "notes" / "deep" / "n.md").read_text() == "kept" and (tmp_path / "groups" / "speaker-info.txt").exists()
    assert not list((tmp_path / "groups" / jobs.AUDIO_DIR).rglob("*.away"))
    for f in (f"{jobs.AUDIO_DIR}/p1/p1_000_mic1.wav", f"{jobs.TEXT_DIR}/p2/p2_001.txt"):
        (tmp_path / "c" / f).with_suffix(".away").rename(tmp_path / "c" / f)
    jobs.multispeaker_conversations(spark, c, str(tmp_path / "conv"))
    conv = wav.read_audio(spark, f"{tmp_path}/conv/{jobs.AUDIO_DIR}").collect()
    assert conv and all(r["duration"] == 60.0 for r in conv)
    turns = spark.read.options(header=True, recursiveFileLookup=True).csv(f"{tmp_path}/conv/{jobs.TURNS_DIR}").collect()
    assert {r["speaker"] for r in turns} == {"p1", "p2"} and all(len(r["timestamp"].split(".")[1]) == 3 for r in turns)

    rng = np.random.default_rng(0)
    for name, s in (("ev", 0.1), ("bg", 0.02)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode_wav(rng.normal(0, s, (2, 15 * FS)), FS))
    ds = str(tmp_path / "ds")
    jobs.mix(spark, f"{tmp_path}/ev.wav", f"{tmp_path}/bg.wav", c, ds, FS, 10)
    assert spark.read.parquet(f"{ds}/mixed.parquet").count() == 160
    jobs.vad(spark, ds)
    assert spark.read.parquet(f"{ds}/vadgt.parquet").count() == 16
    assert jobs.check_integrity(spark, ds, 1, 2, f"{tmp_path}/ev.wav", f"{tmp_path}/bg.wav", True) == 0
    assert "18 checked, 0 failed" in capsys.readouterr().out
    jobs.office_level(spark, f"{tmp_path}/ev.wav", f"{tmp_path}/bg.wav", f"{tmp_path}/office.wav", FS)
    assert "level" in capsys.readouterr().out and (tmp_path / "office.wav").exists()


def clips(root, seconds):
    rng = np.random.default_rng(0)
    for name, s in (("ev", 0.1), ("bg", 0.02)):
        (root / f"{name}.wav").write_bytes(wav.encode_wav(rng.normal(0, s, (2, int(seconds * FS))), FS))
    return f"{root}/ev.wav", f"{root}/bg.wav"


def test_mix_takes_all_rates_and_microphones(spark, tmp_path):
    at = tmp_path / "c" / jobs.AUDIO_DIR / "p1"
    at.mkdir(parents=True)
    (tmp_path / "c" / jobs.TEXT_DIR / "p1").mkdir(parents=True)
    (tmp_path / "c" / jobs.TEXT_DIR / "p1" / "p1_001.txt").write_text("all here")
    (tmp_path / "c" / jobs.TURNS_DIR / "p1").mkdir(parents=True)
    (tmp_path / "c" / jobs.TURNS_DIR / "p1" / "p1_001.csv").write_text('speaker,text,timestamp,original_filename\np1,"one ""two""\nthree",10.000,a\np2,four,9.000,b\n')
    for mic, rate in ((1, FS), (2, 2 * FS)):
        (at / f"p1_001_mic{mic}.wav").write_bytes(wav.encode_wav(0.4 * np.sin(2 * math.pi * 200 * np.arange(2 * rate) / rate), rate))
    jobs.mix(spark, *clips(tmp_path, 5), f"{tmp_path}/c", f"{tmp_path}/ds", FS, 2)
    rows = spark.read.parquet(f"{tmp_path}/ds/mixed.parquet").filter("ebr = 'none'").collect()
    got = {r["stem"]: np.array(r["channels"]) for r in rows}
    assert set(got) == {"p1_001_mic1", "p1_001_mic2"} and all(x.shape == (2, 2 * FS) for x in got.values())
    a, b = (x[0, FS // 2 : -FS // 2] for x in (got["p1_001_mic1"], got["p1_001_mic2"]))
    assert np.abs(a - b).max() < 0.01 * np.abs(a).max()
    jobs.mix(spark, *clips(tmp_path, 5), f"{tmp_path}/c", f"{tmp_path}/files", FS, 2, audio_files=True)
    made = sorted((tmp_path / "files").glob("ebr-*-sar-*/pan_0/p1/*.flac"))
    assert len(made) == 20 and len(list((tmp_path / "files" / "turns").rglob("*.csv"))) == 20 and (tmp_path / "files" / "transc" / "p1_001_mic2.txt").read_text() == "all here"
    clean = next(f for f in made if f.name == "spk_p1__p1_001_mic1__pan_0__ebr-none-sar-none.flac")
    x, rate = flac.decode(clean.read_bytes())
    assert rate == FS and np.array_equal(np.round(x * 32768), got["p1_001_mic1"])
    turns = spark.read.parquet(f"{tmp_path}/ds/turns.parquet").collect()
    assert len(turns) == 20 and {tuple(t["text"] for t in r["turns"]) for r in turns} == {("four", 'one "two"\nthree')}


def test_mix_reads_what_the_earlier_jobs_write(spark, tmp_path):
    corpus(tmp_path / "c")
    c = str(tmp_path / "c")
    jobs.monospeaker_reformat(spark, c, f"{tmp_path}/packed")
    jobs.multispeaker_conversations(spark, c, f"{tmp_path}/conv")
    ev, bg = clips(tmp_path, 61)
    for made in ("packed", "conv"):
        jobs.mix(spark, ev, bg, f"{tmp_path}/{made}", f"{tmp_path}/ds-{made}", FS)
        n = len(list((tmp_path / made / jobs.AUDIO_DIR).rglob("*.flac")))
        assert n and spark.read.parquet(f"{tmp_path}/ds-{made}/mixed.parquet").count() == 10 * n
        said = spark.read.parquet(f"{tmp_path}/ds-{made}/transc.parquet").collect()
        assert len(said) == n and all("words number" in r["text"] for r in said)
    turns = spark.read.parquet(f"{tmp_path}/ds-conv/turns.parquet").collect()
    assert len(turns) == 10 * n and all({t["speaker"] for t in r["turns"]} == {"p1", "p2"} for r in turns)


def test_missing_datasets_are_named(spark, tmp_path):
    for job in (jobs.vad, jobs.check_integrity):
        with pytest.raises(FileNotFoundError):
            job(spark, str(tmp_path / "nothing"))


def test_a_long_segment_needs_little_memory(tmp_path):
    """Ten conditions of a minute at 48 kHz, in a process whose memory is limited."""
    code = """
import resource, sys
import numpy as np
from voxmill.functions.arrays import nested, pcm
from voxmill.operators.scene import renderings
rng = np.random.default_rng(0)
sr, n = 48000, 48000 * 60
clips = {k: rng.normal(0, 0.05, (2, n + 5)) for k in ("events", "background")}
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
count = sum(len(nested([pcm(y)], "int16")) for *_, y in renderings(rng.normal(0, 0.1, n), "s", clips, sr, n, 0.0, 0))
print(count, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    count, grown = map(int, out.stdout.split())
    assert count == 10 and grown < 1000
