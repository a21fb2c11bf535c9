"""Command line: ``spark-submit`` (or ``python -m driftlens``) over folders of lockfiles and archives.

diff  LOCKS ARCHIVES OUT   compare the old and new lockfile of every run below LOCKS
scan  LOCKS ARCHIVES OUT   posture of the new lockfiles alone

LOCKS is laid out as run/side/file, ARCHIVES as name/version/file. Reports go to OUT/<format>. The exit
code is 2 when a run is blocked or a --fail-on detector fired, 1 for warnings, else 0.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from driftlens.operators import escalate, manifest, policy
from driftlens.operators.aggregate import exit_code
from driftlens.plans import diff
from driftlens.session import build_session
from driftlens.sinks import reports
from driftlens.sources import archives, lists, lockfiles


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="driftlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["diff", "scan"])
    parser.add_argument("locks")
    parser.add_argument("archives")
    parser.add_argument("out")
    parser.add_argument("--popular", help="file of popular package names, one per line")
    parser.add_argument("--domains", help="file of throw-away mail domains, one per line")
    parser.add_argument("--config", help="JSON configuration file")
    parser.add_argument("--fail-on", action="append", default=[], help="detector id or prefix that forces exit code 2")
    parser.add_argument("--format", action="append", choices=["json", "sarif", "md", "osif", "tty"], help="default: json")
    parser.add_argument("--year", type=int, default=1970, help="year used in incident ids")
    return parser.parse_args(argv)


def main(argv: list[str]) -> int:
    args = arguments(argv)
    spark = build_session()
    config = policy.Config()
    if args.config:
        with open(args.config, encoding="utf-8") as stream:
            config = policy.parse_config(stream.read())
    reference = diff.Lists(
        popular=lists.read_popular_names(spark, args.popular) if args.popular else spark.createDataFrame([], "name string, ord long"),
        domains=lists.read_domains(spark, args.domains) if args.domains else spark.createDataFrame([], "domain string"),
        trust=manifest.trust_table(spark), advisories=escalate.builtin_advisories(spark),
    )
    snapshots = diff.analyse(archives.read_archives(spark, args.archives))
    run = diff.run_diff if args.command == "diff" else diff.run_scan
    r = run(lockfiles.lock_tables(lockfiles.read_lockfiles(spark, args.locks)), snapshots, reference, policy.config_tables(spark, config))
    writers = {
        "json": lambda: reports.json_lines(r.runs, r.findings, r.changes, r.errors, r.rollup),
        "sarif": lambda: reports.sarif_lines(r.runs, r.findings),
        "md": lambda: reports.markdown_lines(r.findings, r.changes, r.runs),
        "osif": lambda: reports.incident_lines(r.findings, r.runs, args.year),
        "tty": lambda: reports.console_lines(r.findings, r.rollup, r.errors, r.runs),
    }
    for name in args.format or ["json"]:
        reports.write_lines(writers[name](), f"{args.out}/{name}")
    wanted = spark.createDataFrame([(d,) for d in [*args.fail_on, *config.failOn]], "detector string")
    forced = policy.forced_failure(r.findings, wanted, by_prefix=True).withColumn("forced", F.lit(True))
    graded = r.runs.join(forced, "run_id", "left").select(exit_code(F.col("verdict"), F.coalesce("forced", F.lit(False))).alias("code"))
    return graded.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
