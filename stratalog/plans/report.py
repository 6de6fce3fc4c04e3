"""JSON and text reports, and the same as distributed files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEP_FIELDS
from . import views


def rendered(manifests: DataFrame) -> DataFrame:
    """manifests with a column block: the manifest's lines in the text report."""
    flat = ~F.exists("dependencies", lambda d: F.coalesce(d["section"], F.lit("")) != "")
    line = lambda lead, text: F.concat(F.lit(lead), text, F.lit("\n"))
    listed = F.array_join(F.transform("dependencies", lambda d: line("  - ", views.display(d))), "")
    group = lambda d: F.when(F.coalesce(d["section"], F.lit("")) == "", views.DEFAULT_GROUP).otherwise(d["section"])
    names = F.array_distinct(F.transform("dependencies", group))
    grouped = F.array_join(
        F.transform(names, lambda g: F.concat(F.when(g == views.DEFAULT_GROUP, F.concat(F.lit("  "), g, F.lit("\n"))).otherwise(F.concat(F.lit("  "), g, F.lit(":\n"))), F.array_join(F.transform(F.filter("dependencies", lambda d: group(d) == g), lambda d: line("    - ", views.display(d))), ""))), ""
    )
    deps: Column = F.when(F.coalesce(F.size("dependencies"), F.lit(0)) == 0, "").when(flat, listed).otherwise(grouped)
    warned = F.coalesce(F.array_join(F.transform("warnings", lambda w: line("  warning: ", w)), ""), F.lit(""))
    return manifests.withColumn("block", F.concat(F.lit("\n"), "path", F.lit(" "), views.label(), F.lit("\n"), deps, warned))


#: Lines of the summary, in order.
COUNTED = (("extracted", "with extracted dependencies"), ("empty", "confirmed empty"), ("present-not-extracted", "with dependencies present, not extracted"), ("unknown", "with dependency status unknown"))


def text_report(manifests: DataFrame, root: str, show_empty: bool = False) -> Iterator[str]:
    """The report in parts. Counts come from the cluster, blocks stream in path order."""
    counts = {r["status"]: r["n"] for r in manifests.groupBy(views.status().alias("status")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    yield f"Root: {root}\n"
    if not total:
        yield "No manifests found.\n"
        return
    yield f"\nFound {total} {'manifest' if total == 1 else 'manifests'}:\n"
    yield "".join(f"- {counts[k]} {what}\n" for k, what in COUNTED if counts.get(k))
    for row in rendered(views.visible(manifests, show_empty)).orderBy("path", "type").select("block").toLocalIterator():
        yield row["block"]


def entry(row) -> dict:
    out: dict = {"type": row["type"], "path": row["path"]}
    deps = [{f: d[f] for f in DEP_FIELDS if d[f]} for d in row["dependencies"] or []]
    if deps:
        out["dependencies"] = deps
    out["has_dependencies"] = row["has_dependencies"]
    if row["warnings"]:
        out["warnings"] = list(row["warnings"])
    return out


def json_report(manifests: DataFrame, root: str) -> str:
    """One JSON document with two-space indents. For many manifests, write_document writes it from many tasks, and write_json leaves them distributed."""
    found = [entry(r) for r in manifests.orderBy("path", "type").toLocalIterator()]
    return json.dumps({"root": root, "manifests": found or None}, indent=2, ensure_ascii=False) + "\n"


def write_json(manifests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one per manifest, range-partitioned by path."""
    manifests.repartitionByRange("root", "path").sortWithinPartitions("root", "path").write.mode(mode).json(path)


def write_text(manifests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rendered(manifests).repartitionByRange("root", "path").sortWithinPartitions("root", "path").select("block").write.mode(mode).text(path, lineSep="")
