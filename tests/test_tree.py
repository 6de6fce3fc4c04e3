"""Trees on disk, the command line and streams."""

import io
import json
import os

import pytest

from pyspark.sql import functions as F

from stratalog.__main__ import ignore_list, run
from stratalog.functions.paths import K
from stratalog.functions.text import clean_path, java_regex
from stratalog.operators.documents import read_xml
from stratalog.rules import builtin_rules
from stratalog.plans.detect import detect
from stratalog.plans.report import json_report
from stratalog.sources.tree import entries, list_tree, read_tree
from stratalog.sources.document import write_document
from stratalog.streaming.watch import latest_manifests, watch


def tree(tmp_path):
    for path, text in {"requirements.txt": "a==1\n-r sub/.hidden\n", "sub/.hidden": "b", ".github/go.mod": "module x\n", "a/.terraform.lock.hcl": "", "node_modules/go.sum": "", "x/package.json": "{}"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return tmp_path


def test_tree_and_command_line(spark, tmp_path):
    root = tree(tmp_path)
    assert sorted(r["path"] for r in list_tree(spark, str(root)).collect()) == [".github/go.mod", "a/.terraform.lock.hcl", "requirements.txt", "sub/.hidden", "x/package.json"]
    got = {r["path"]: (r["name"], bytes(r["content"])) for r in read_tree(spark, str(root), ()).collect()}
    assert len(got) == 6 and got["sub/.hidden"] == (".hidden", b"b") and got["node_modules/go.sum"] == ("go.sum", b"")
    out, err = io.StringIO(), io.StringIO()
    assert run(["--json", str(root)], out, err, spark) == 0
    got = {m["path"]: m for m in json.loads(out.getvalue())["manifests"]}
    assert list(got) == [".github/go.mod", "a/.terraform.lock.hcl", "requirements.txt", "x/package.json"]
    assert [d["raw"] for d in got["requirements.txt"]["dependencies"]] == ["a==1", "b"]
    assert run([str(root / "no")], out, err, spark) == 1 and "not a directory" in err.getvalue()
    assert run(["a", "b"], out, err, spark) == 1 and ignore_list(" a,,b ") == ("a", "b")


def test_listing_by_levels(spark, tmp_path):
    """Thousands of files, listed by many tasks that hand folders on; pruned folders are never entered; several roots."""
    want = set()
    for i in range(60):
        for j in range(5):
            folder = tmp_path / "one" / f"d{i}" / f"e{j}" / "f"
            folder.mkdir(parents=True)
            for k in range(40):
                (folder / f".n{k}").write_bytes(b"")
                want.add(f"d{i}/e{j}/f/.n{k}")
    bad = tmp_path / "one" / "vendor"
    bad.mkdir()
    (bad / "x").write_text("x")
    os.symlink(tmp_path / "one" / "d1", tmp_path / "one" / "link")  # a link is a file, and not followed
    want.add("link")
    for folders in (3, 10**6):
        got = list_tree(spark, str(tmp_path / "one"), task_folders=folders)
        rows = [r["path"] for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a").write_text("")
    assert list_tree(spark, [str(tmp_path / "two"), str(tmp_path / "one"), str(tmp_path / "two")]).count() == len(want) + 1
    assert sorted(entries(str(tmp_path / "one"), iter(["d1"]), frozenset(), 1)) == [(f"d1/e{j}", True) for j in range(5)]
    with pytest.raises(ValueError):
        list_tree(spark, str(tmp_path / "no"))


def test_only_candidates_are_opened(spark, tmp_path):
    """Links to nowhere stand for files whose contents nobody may ask for."""
    root = tree(tmp_path)
    for name in ("README.md", "go.sum", "sub/notes.txt", "package.json", "sub/big.tf"):
        os.symlink("/nowhere/at/all", root / name)
    (root / "sub" / "job.py").write_text("x")
    rules = builtin_rules().only("go-sum", "python-requirements", "js", "python-setup-py")
    got = {r["path"]: r for r in detect(list_tree(spark, str(root)), rules, on_error="warn").collect()}
    assert got["go.sum"]["type"] == "go-sum" and got["go.sum"]["warnings"] is None  # by its name alone
    assert [d["raw"] for d in got["requirements.txt"]["dependencies"]] == ["a==1", "b"]  # the included file is opened, though no rule selects it
    assert got["package.json"]["warnings"] == ["read candidate file 'package.json': No such file or directory"]
    assert sorted(got) == ["go.sum", "package.json", "requirements.txt", "x/package.json"]
    with pytest.raises(Exception, match="read candidate file"):
        detect(list_tree(spark, str(root)), rules).collect()
    every = detect(list_tree(spark, str(root)), builtin_rules(), on_error="skip").select("path", "type", "dependencies").collect()
    whole = detect(read_tree(spark, str(tree(tmp_path / "again"))), builtin_rules()).select("path", "type", "dependencies").collect()
    assert {r["path"]: r for r in whole}.items() <= {r["path"]: r for r in every}.items()


def test_one_odd_file_ends_no_scan(spark, tmp_path):
    """Nesting that would end a reader is the file's own error; the rest is read."""
    deep = 40_000
    odd = {
        "y/Chart.yaml": "dependencies: " + "[" * deep + "]" * deep, "b/Chart.yaml": "dependencies:\n" + "".join(" " * i + "-\n" for i in range(deep // 40)), "p/setup.py": "from setuptools import setup\nsetup(install_requires=" + "[" * deep + "])\n",
        "q/setup.py": "from setuptools import setup\nx = " + "[" * 3000 + "]" * 3000 + "\nsetup(install_requires=['a'], y=x)\n", "j/package.json": '{"dependencies": ' + "[" * deep + "]" * deep + "}", "t/Cargo.toml": "dependencies = " + "[" * deep + "]" * deep,
        "x/pom.xml": "<a>" * deep + "</a>" * deep, "h/main.tf": 'resource "aws_glue_job" "x" { default_arguments = ' + "[" * deep + "]" * deep + " }", "s/job.ts": 'import { CfnJob } from "aws-cdk-lib/aws-glue";\nnew CfnJob(1, 2, ' + "{a: " * deep + "1" + "}" * deep + ")", "good/Chart.yaml": "dependencies: [a]",
    }
    for path, text in odd.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r["path"]: r for r in detect(list_tree(spark, str(tmp_path)), builtin_rules(), on_error="warn").collect()}
    assert got["good/Chart.yaml"]["has_dependencies"] and got["b/Chart.yaml"]["warnings"] is None
    assert [d["raw"] for d in got["q/setup.py"]["dependencies"]] == ["a"]
    for path in ("y/Chart.yaml", "j/package.json", "t/Cargo.toml"):
        assert got[path]["warnings"] and got[path]["dependencies"] is None, path
    assert not got["x/pom.xml"]["has_dependencies"] and "s/job.ts" not in got and "h/main.tf" not in got


def test_xml_is_read_to_its_first_hit():
    text = b"<project xmlns='m'><x/><dependencies>" + b"<dependency/>" * 100_000
    reach = (3, frozenset({"".join(K + n for n in ("project", "dependencies", "dependency"))}))
    assert [n[1] for n in read_xml(text, reach)] == ["element"]  # the text is cut, and nobody notices
    assert read_xml(text)[-1][1] == "error" and read_xml(b"<project><a></project>", reach)[-1][1] == "error"
    assert read_xml(b"<project><a><dependencies><dependency/></dependencies></a></project>", reach) == []
    assert read_xml(b"<project>" + b" " * 200_000 + b"<dependencies><dependency/></dependencies></project>", reach) and read_xml(b" ", reach) == []


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "go.sum").write_text("x")
    (root / "requirements.txt").write_text("x==1")
    rules = builtin_rules().only("go-sum", "python-requirements")
    q = watch(spark, str(root), str(tmp_path / "out"), str(tmp_path / "state"), rules, available_now=True)
    q.awaitTermination(120)
    assert {r["type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"go-sum", "python-requirements"}


def test_stream_includes_of_other_batches(spark, tmp_path):
    """An include of an earlier batch is found; one that comes a batch later is resolved then."""
    root = tmp_path / "in"
    root.mkdir()
    rules = builtin_rules().only("python-requirements", "go-sum")

    def arrive(**named):
        for name, text in named.items():
            (root / f"{name}.txt").write_text(text)
        q = watch(spark, str(root), str(tmp_path / "out"), str(tmp_path / "state"), rules, available_now=True)
        q.awaitTermination(120)
        got = latest_manifests(spark, str(tmp_path / "out")).collect()
        return {r["path"]: ([d["raw"] for d in r["dependencies"] or []], len(r["warnings"] or [])) for r in got}

    assert arrive(requirements="a==1\n-r late.txt\n", base="b==2\n")["requirements.txt"] == (["a==1"], 1)
    assert arrive(requirements_dev="-r base.txt\nc\n")["requirements_dev.txt"] == (["b==2", "c"], 0)
    assert arrive(late="d==4\n-r later.txt\n")["requirements.txt"] == (["a==1", "d==4"], 1)
    got = arrive(later="e\n")
    assert got["requirements.txt"] == (["a==1", "d==4", "e"], 0) and got["requirements_dev.txt"] == (["b==2", "c"], 0)


def test_document_from_many_tasks(spark, tmp_path):
    rows = [(str(i % 3), f"p{i * 7919 % 500:03d}/{'é' * (i % 2)}requirements.txt", "requirements.txt", bytearray(f"x{i}==1\n".encode())) for i in range(500)]
    files = spark.createDataFrame(rows, "root string, path string, name string, content binary").repartition(9)
    manifests = detect(files, builtin_rules().only("python-requirements")).withColumn("root", F.lit("all"))
    out = tmp_path / "report.json"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_document(manifests, str(out), "/all/é")
        assert out.read_text() == json_report(manifests, "/all/é") and len(json.loads(out.read_text())["manifests"]) == 500
        before = out.read_bytes()
        with pytest.raises(Exception, match="no such luck"):
            write_document(manifests.withColumn("type", F.when(F.col("path").startswith("p4"), F.raise_error(F.lit("no such luck"))).otherwise(F.col("type"))), str(out), "x")
        assert out.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["report.json"]
        write_document(manifests.limit(0), str(out), "/none")
        assert out.read_text() == json_report(manifests.limit(0), "/none")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_text(spark):
    assert java_regex(r"^a\$[$]$") == r"(?d)^a\$[$]\z" and java_regex("(?im)^a$") == "(?d)(?im)^a$"
    rows = spark.createDataFrame([("a/../b/./c",), ("../x",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in rows.select(clean_path(F.col("p"))).collect()] == ["b/c", "../x", "../b", ""]
