"""python -m stratalog [--json] [--show-empty] [--ignore NAMES] [--rules FILE] [path]"""

from __future__ import annotations

import argparse
import os
import sys

from .operators.select import DEFAULT_IGNORED
from .rules import RuleError, builtin_rules, load_rules


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog", description="List the software manifests below a folder and what they depend on.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--json", action="store_true", help="print one JSON document instead of text")
    p.add_argument("--show-empty", action="store_true", help="print manifests without dependencies too")
    p.add_argument("--ignore", default="", help="names of folders to leave out in place of the usual ones, with commas between")
    p.add_argument("--rules", default="", help="a YAML rule file in place of the built-in rules")
    return p


def ignore_list(value: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.split(",") if x.strip()) if value else DEFAULT_IGNORED


def run(args: list[str], out=None, err=None, spark=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        given = parser().parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        rules = load_rules(given.rules) if given.rules else builtin_rules()
        if not os.path.isdir(given.path):
            raise ValueError(f"{given.path}: not a directory")
        from pyspark.errors import PySparkException
        from pyspark.sql import SparkSession

        from .plans.detect import detect
        from .plans.report import json_report, text_report
        from .sources.tree import list_tree
        from .storage import kept

        spark = spark or SparkSession.builder.appName("stratalog").getOrCreate()
        root = os.path.abspath(given.path)
        try:
            manifests = kept(detect(list_tree(spark, root, ignore_list(given.ignore)), rules, ignored=()))
            for part in [json_report(manifests, root)] if given.json else text_report(manifests, root, given.show_empty):
                out.write(part)
        except PySparkException as e:
            raise ValueError(str(e).splitlines()[0]) from None
    except (ValueError, OSError, RuleError) as e:
        err.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
