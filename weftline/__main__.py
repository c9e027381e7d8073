"""Build one digest from a folder of .eml files and print it as JSON.

python -m weftline --messages DIR --folder NAME --start 2026-01-01 --end 2026-01-31 [--runs DIR] [--flags DIR] [--log FILE]
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline import logs
from weftline.config import Settings
from weftline.operators.decisions import RuleProvider
from weftline.plans.digest import Providers, build
from weftline.runtime import scratch
from weftline.sources import mail
from weftline.sources.runlog import RunLog


def offline() -> Providers:
    """Deterministic stand-ins for the decision stages: very short items are noise, neighbours by similarity are one story, all else is kept."""
    return Providers(RuleProvider({"is_noise": F.length("body") < 30}), RuleProvider({"relationship": F.lit("same_story")}), RuleProvider({"keep": F.lit(True), "confidence": F.lit("high"), "reasoning": F.lit("")}))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("--messages", required=True)
    p.add_argument("--folder", required=True)
    p.add_argument("--start", required=True, type=dt.date.fromisoformat)
    p.add_argument("--end", required=True, type=dt.date.fromisoformat)
    p.add_argument("--runs")
    p.add_argument("--flags")
    p.add_argument("--log")
    a = p.parse_args(args)
    logs.configure(a.log)
    spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log = RunLog(spark, a.runs or scratch(spark, "runs"))
    digest = build(mail.read_eml(spark, a.messages, a.folder.strip()), a.folder, a.start, a.end, offline(), log, Settings.from_env(), a.flags, require_folder=True)
    print(json.dumps(digest, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
