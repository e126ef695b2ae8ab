"""Command line: nine subcommands over corpora of FLAC or WAV and text files in shared folders."""

from __future__ import annotations

import argparse


def _session():
    from pyspark.sql import SparkSession

    from voxmill.runtime import ship

    # Audio rows are large: few of them travel in one Arrow batch.
    spark = SparkSession.builder.appName("voxmill").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _run(name: str):
    def call(args: argparse.Namespace) -> int:
        from voxmill.plans import jobs

        given = {k: v for k, v in vars(args).items() if k not in ("command", "func")}
        return int(getattr(jobs, name)(_session(), **given) or 0)

    return call


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxmill", description="Build and audit simulated office-speech datasets on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *options: str, job: str | None = None):
        c = sub.add_parser(name, help=help_)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        c.set_defaults(func=_run(job or name.replace("-", "_")))
        return c

    add("monospeaker-reformat", "pack utterances into segments of one speaker", "input_vctk_dir", "output_vctk_dir")
    add("multispeaker-lengths", "match utterance groups to the turn lengths of calls", "callhome_dir", "vctk_dir", "data_dir")
    add("multispeaker-group", "write matched groups as files", "groups_path", "input_vctk_dir", "output_vctk_dir")
    add("multispeaker-conversations", "build two-speaker conversations", "input_vctk_dir", "output_vctk_dir")
    mix = add("mix", "render segments in all conditions", "events_path", "background_path", "vctk_path", "out_dataset_path")
    mix.add_argument("--sr", type=int, default=48000)
    mix.add_argument("--segment_duration", type=float, default=60)
    mix.add_argument("--audio_files", action="store_true", help="also write each condition as an audio file")
    add("vad", "frame-level activity of the clean files", "dataset_path")
    level = add("office-level", "level of two clips together", "keyboard_path", "office_path", "output_path")
    level.add_argument("--sr", type=int, default=48000)
    for name in ("check-integrity", "check-integrity-old"):
        c = add(name, "recover level ratios; exit status 1 on any failure", "dataset_path", job="check_integrity")
        c.add_argument("--num_speakers", type=int, default=1)
        c.add_argument("--num_segments", type=int, default=1)
        c.add_argument("--events_path")
        c.add_argument("--background_path")
        c.add_argument("--check_ebr", action="store_true")
        c.set_defaults(layout="old" if name.endswith("old") else "current")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.func(args)
