"""Command line: ``python -m quillveil scan|redact PATH [--out DIR] [--config FILE] [--json]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.redact import exploded, redact, report_json
from .runtime import materialize
from .schema import Settings
from .sources.files import extract_text, output_name, read_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillveil", description="Find or redact sensitive entities in files.")
    p.add_argument("action", choices=("scan", "redact"))
    p.add_argument("path", help="a file or folder that Spark can read")
    p.add_argument("--out", help="where redacted texts and reports are written (redact)")
    p.add_argument("--config", help="a TOML file; else config.toml in the folder QUILLVEIL_CONFIG_DIR")
    p.add_argument("--json", action="store_true", help="one JSON report a file, in place of counts")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    settings = Settings.load(args.config)
    rows = extract_text(read_files(spark, args.path), settings)
    # written once: every report and count below reads what was found, and nothing is detected again
    done = materialize(redact(rows, "text", settings), "cli")
    skipped = F.col("skip_reason").isNotNull()
    if args.action == "redact":
        if not args.out:
            raise ValueError("redact needs --out")
        name = output_name(F.col("path"), F.col("content_hash"), settings.fingerprint())
        hit = done.filter(~skipped & (F.col("found") > 0))
        hit.select("path", name.alias("name"), "redacted", "found").write.mode("overwrite").parquet(f"{args.out}/redacted")
        report_json(hit, "path").write.mode("overwrite").parquet(f"{args.out}/reports")
    told = done.filter(skipped).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")).orderBy("skip_reason")
    lines = [f"skipped\t{r.skip_reason}\t{r.n}" for r in told.collect()]  # one row a reason
    if args.json:
        return chain((r.report for r in report_json(done.filter(~skipped), "path").toLocalIterator()), lines)
    counts = exploded(done).filter(~F.col("s.entity_type").isin(*settings.public_types)).groupBy(F.col("s.entity_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return chain([f"{r.t}\t{r.n}" for r in counts.orderBy("t").collect()], lines)  # one row a type


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillveil").getOrCreate()
    for line in run(spark, args):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
