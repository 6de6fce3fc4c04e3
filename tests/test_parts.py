"""Tables between the steps are cut so that no task's share grows with the input."""

import pytest
from pyspark.sql import functions as F

from stratalog.operators import lines, presence
from stratalog.operators.documents import NODES
from stratalog.plans import detect as plan
from stratalog.plans import views
from stratalog.rules import builtin_rules, parse_rules
from stratalog.schema import MANIFESTS
from stratalog.sources.tree import files_from_table

ROWS = 20_001


def cut(monkeypatch, module, call):
    """What call returns, and per table that module keeps its columns, rows and the rows of its largest file."""
    seen, real = [], module.kept

    def kept(df, *a):
        out = real(df, *a)
        per = out.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
        seen.append((set(out.columns), per[0] or 0, per[1] or 0))
        return out

    monkeypatch.setattr(module, "kept", kept)
    return call(), seen


def one_task(spark, name, body):
    """Files of one partition, as a small table with a single row group gives them."""
    return files_from_table(spark.range(0, ROWS, 1, 1), F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(name)), F.lit(body))


def test_documents_are_dealt_to_many_tasks(spark, monkeypatch):
    rules = parse_rules("rules: [{name: piped, filename-regex: '[.]pipe$', yaml: {exists: 'stages[].tag'}}]")
    got, seen = cut(monkeypatch, plan, lambda: plan.detect(one_task(spark, ".pipe", "stages: [{tag: 1}, {tag: 2}]\n"), rules))
    assert got.count() == ROWS
    files, nodes = (next(x for x in seen if column in x[0]) for column in ("content", "kind"))
    assert files[1] == ROWS and files[2] <= plan.FILE_ROWS
    assert nodes[1] == 6 * ROWS and nodes[2] <= plan.PART_ROWS


SOURCES = {
    "terraform.aws_glue_job.python": ("/main.tf", 'resource "aws_glue_job" "j" {\n  default_arguments = {\n    "--job-language" = "python"\n    "--additional-python-modules" = "a"\n  }\n}\n'),
    "python.cdk.aws_glue_job.python": ("/x.py", 'from aws_cdk import aws_glue\nM = "a"\naws_glue.CfnJob(self, "x", default_arguments={"--job-language": "python", "--additional-python-modules": M})\n'),
}


@pytest.mark.parametrize("kind", SOURCES)
def test_sources_are_dealt_to_many_tasks(spark, monkeypatch, kind):
    got, seen = cut(monkeypatch, plan, lambda: plan.detect(one_task(spark, *SOURCES[kind]), builtin_rules().only(kind)))
    assert got.count() == ROWS
    files = next(x for x in seen if "content" in x[0])
    assert files[1] == ROWS and files[2] <= plan.FILE_ROWS


def filters(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]


def test_only_rows_that_tell_are_grouped(spark):
    """What is sorted to group it grows with documents and hits, not with all nodes."""
    rules = parse_rules("rules: [{name: q, filename-regex: '[.]q$', yaml: {query: 'a[].b'}}, {name: t, filename-regex: '[.]t$', toml: {exists-any: ['x.y']}}]")
    nodes = spark.createDataFrame([], NODES)
    assert any("= error" in x for x in filters(presence.yaml_queries(nodes, rules)[0]))
    assert any("= error" in x for x in filters(presence.presence(nodes, rules)))


def test_lines_are_cut(spark, monkeypatch):
    got, seen = cut(monkeypatch, lines, lambda: plan.detect(one_task(spark, "/requirements.txt", "a==1\nb\na==2\n"), builtin_rules().only("python-requirements")))
    assert got.count() == ROWS
    texts = next(x for x in seen if "text" in x[0])
    assert texts[1] == 3 * ROWS and texts[2] <= plan.PART_ROWS


def test_usage_groups_by_names(spark):
    """A name that a file lists twice is one manifest with two uses; nothing is grouped per file."""
    one = lambda name, version=None: (None, name, version, None, None, None, None)
    rows = [("", "x", "t", [one("a", "2"), one("b"), one("a", "1"), one(None, "9"), one("a")], True, None), ("", "y", "t", [one("a", "1")], True, None), ("", "z", "t", None, None, None)]
    got = views.package_usage(spark.createDataFrame(rows, MANIFESTS))
    assert sorted(map(tuple, got.collect())) == [("a", 2, 4, 2), ("b", 1, 1, 0)]
    assert not any("Aggregate" in x and "path" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
