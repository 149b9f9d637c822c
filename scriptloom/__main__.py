"""Command line: ``python -m scriptloom extract|translate|qa|build``.

Explicit paths win over the profile's, which are relative to the profile's folder.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Profile, load_profile, load_rules
from .operators import extract, patch, qa, translate
from .shared import written
from .shipping import ship_package
from .sources import files, scripts
from .sources.store import ProgressStore

#: Batches of each parallel call between two writes to the store; each batch is in the journal at once.
WAVE = 16


def session() -> SparkSession:
    spark = SparkSession.builder.appName("scriptloom").getOrCreate()
    ship_package(spark)
    return spark


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Cache until the command ends; files may change between two commands of one session."""
    _HELD.append(df.cache())
    return _HELD[-1]


def run_extract(args: argparse.Namespace, fail) -> int:
    profile = load_profile(args.profile) if args.profile else Profile({})
    source, out = profile.path("source_dir", override=args.src), profile.path("strings_file", override=args.out)
    if source is None or out is None:
        fail("need --src and --out, or a --profile providing source_dir and strings_file")
    if not os.path.isdir(source):
        print(f"source dir not found: {source}", file=sys.stderr)
        return 1
    lines = hold(scripts.read_lines(session(), source))
    found = hold(extract.in_order(extract.occurrences(lines, args.screens)))
    for r in extract.per_file(lines, found).orderBy("file").toLocalIterator():
        print(f"{r['file']}: {r['n_strings']} strings")
    total, unique = extract.totals(found).first()
    print(f"\nTotal: {total} occurrences" + (" (dedupe disabled)" if args.no_dedupe else f", {unique} unique strings"))
    scripts.save_entries(found if args.no_dedupe else extract.first_occurrences(found), out)
    print(f"Wrote {out}")
    return 0


def run_translate(args: argparse.Namespace, fail) -> int:
    profile = load_profile(args.profile)
    translate.make_call(profile)  # an unknown provider ends the run here
    spark = session()
    entries = hold(scripts.load_entries(spark, profile.path("strings_file", "strings.json", args.strings)))
    target = profile.path("progress_file", "translations.json", args.progress)
    system, warning = translate.system_prompt(profile)
    if warning:
        print(warning)
    # every batch is on file below the store as soon as it is answered, every wave is a write to it; what an interrupted run left counts
    store = ProgressStore(spark, args.store or f"{target}.store")
    journal = translate.journal_folder(spark, f"{store.folder}/journal")
    left_over = spark.read.schema(translate.JOURNAL).json(journal, pathGlobFilter="*.json")
    if not left_over.isEmpty():
        store.append(translate.accepted(left_over))
    later = lambda rows: rows.withColumn("pos", F.col("pos") + (1 << 40))
    before = hold(scripts.load_progress(spark, target))
    progress = written(translate.upserted(before, later(store.read())))
    todo = written(translate.batches(translate.remaining(entries, progress), profile.batch_size))
    total, done, left = translate.totals(entries, progress).first()
    print(f"Total: {total} | Done: {done} | Todo: {left}")
    if not left:
        print("All strings already translated.")
    last, wave = -(-left // profile.batch_size), WAVE * (args.parallel or 1)
    for begin in range(0, last, wave):
        mine = todo.filter((F.col("batch") >= begin) & (F.col("batch") < begin + wave)).drop("place", "batch")
        # the wave's entries are all untranslated: an empty progress makes the pass take each of them
        results = written(translate.translate(mine, progress.limit(0), profile, system, args.pause, journal=journal, parallel=args.parallel))
        store.append(translate.accepted(results))
        counts = results.agg(F.count(F.lit(1)), F.count_if(F.col("status") == "ok")).first()
        print(f"Batches {begin + 1}-{min(begin + wave, last)} of {last}: accepted {counts[1]}/{counts[0]}.")
    n = scripts.save_progress(translate.upserted(before, later(store.read())), target)
    print(f"Total done: {n}")
    store.clear()
    return 0


def run_qa(args: argparse.Namespace, fail) -> int:
    profile = load_profile(args.profile)
    spark = session()
    entries = hold(scripts.load_entries(spark, profile.path("strings_file", "strings.json", args.strings)))
    progress = hold(scripts.load_progress(spark, profile.path("progress_file", "translations.json", args.translations)))
    rules, warning = load_rules(profile, args.technical_only)
    if warning:
        print(warning)
    found = hold(qa.issues(entries, progress, rules, profile.keep, args.technical_only))
    counts, code = qa.report_counts(found, args.technical_only)
    frame = qa.report_frame(found, profile, entries.count(), progress.count(), counts)
    for r in frame.orderBy(*qa.REPORT_ORDER).toLocalIterator():
        print(r["value"])
    if args.report:
        files.write_lines(frame, qa.REPORT_ORDER, args.report)
        print(f"Report written to {args.report}")
    return code


def run_build(args: argparse.Namespace, fail) -> int:
    profile = load_profile(args.profile)
    spark = session()
    progress = hold(scripts.load_progress(spark, profile.path("progress_file", "translations.json", args.translations)))
    strings = profile.path("strings_file", "strings.json", args.strings)
    entries = scripts.load_entries(spark, strings) if scripts.exists(spark, strings) else None
    print(f"Building patch with {progress.count()} translations...")
    out = profile.path("output_dir", "output", args.out)
    for name in scripts.write_rendered(patch.build(progress, profile, entries, args.split_size), out):
        print(f"Wrote {name}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(required=True)

    def command(name: str, run, text: str, *options: tuple) -> None:
        p = commands.add_parser(name, help=text)
        p.add_argument("--profile", required=name != "extract")
        for flags, settings in options:
            p.add_argument(flags, **settings)
        p.set_defaults(run=run, fail=p.error)

    flag = {"action": "store_true"}
    command("extract", run_extract, "scripts to strings", ("--src", {}), ("--out", {}), ("--no-dedupe", flag), ("--screens", flag))
    command("translate", run_translate, "translate what is left", ("--strings", {}), ("--progress", {}), ("--pause", {"type": float, "default": 0.5}), ("--store", {}), ("--parallel", {"type": int, "default": 1}))
    command("qa", run_qa, "check translations", ("--strings", {}), ("--translations", {}), ("--technical-only", flag), ("--report", {}))
    command("build", run_build, "write language files", ("--translations", {}), ("--strings", {}), ("--out", {}), ("--split-size", {"type": int, "default": 0}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args, args.fail)
    finally:
        while _HELD:
            _HELD.pop().unpersist()


if __name__ == "__main__":
    sys.exit(main())
