"""The index of selectors against trying every rule on every file."""

import random
import re

from pyspark.sql import functions as F

from stratalog.functions.paths import glob_regex
from stratalog.operators.select import candidate_ordinals
from stratalog.rules import Rule, Ruleset, builtin_rules


def compiled(rules):
    made = lambda p, end: re.compile(p.replace(end, r"\Z")) if p else re.compile("")
    return [(r, made(r.filename_regex, "$"), made(r.path_glob and glob_regex(r.path_glob), r"\z")) for r in rules.rules]


def brute(patterns, name, path):
    out = []
    for r, own, glob in patterns:
        if own.search(name) and glob.search(path):
            out.append(r.ordinal)
            if r.parser is None:
                break
    return out


def names_for(rules, r):
    """Names that rules accept, and near misses."""
    out = ["", "x", "a.b", ".", "..", "é.py", "go.sum.bak"]
    for rule in rules.rules:
        plain = (rule.filename_regex or rule.path_glob.rpartition("/")[2]).strip("^$").replace("\\.", ".")
        for filler in ("", "x", "a-1"):
            n = re.sub(r"\([^)]*\)\??|\[[^\]]*\][*+]?", filler, plain).replace(".*", filler).replace("*", filler).replace("?", "")
            out += [n, n + r.choice("xy."), r.choice("xy.") + n, n.upper()]
    return sorted(set(out))


def check(spark, rules, names, r):
    rows = [(n, r.choice(["", "a/", "src/deep/", ".github/workflows/", "x/.github/workflows/"]) + n) for n in names]
    frame = spark.createDataFrame(rows, "name string, path string")
    got = {(x["name"], x["path"]): x["o"] for x in frame.select("name", "path", candidate_ordinals(rules, F.col("name"), F.col("path")).alias("o")).collect()}
    patterns = compiled(rules)
    assert got == {(n, p): brute(patterns, n, p) for n, p in rows}
    assert sum(map(bool, got.values())) > len(rules.rules) // 2


def test_all_built_in_rules(spark):
    rules = builtin_rules()
    assert sum(x.index_key is None for x in rules.rules) <= 2
    check(spark, rules, names_for(rules, random.Random(1)), random.Random(2))


def test_a_thousand_custom_rules(spark):
    kinds = (r"^n{0}$", r".*\.e{0}$", r"^pre{0}.*$", r"^pre{0}[a-z]?\.t$", r"x{0}", r"(?i)^case{0}$", r"^a{0}$|^b{0}\.z$", r"\.k{0}$", r"^d{0}\.\w+$", r"^lon{0}g+$")
    made = [Rule(i, f"t{i}", kinds[i % 10].format(i), None, "go-mod" if i % 3 else None) for i in range(900)]
    made += [Rule(900 + i, f"t{i}", None, (f"**/d{i}/*.g{i}", f"a/n{i}.txt", f"**/*x{i}", f"*/[ab]{i}.c", f"src/**")[i % 5], "go-mod") for i in range(60)]
    made += [Rule(960 + i, f"t{i}", rf"^both{i}\.q$", f"src/**/both{i}.q", "go-mod") for i in range(40)]
    r = random.Random(3)
    names = [f(i) for i in r.sample(range(1000), 150) for f in (lambda i: f"n{i}", lambda i: f"f.e{i}", lambda i: f"pre{i}", lambda i: f"pre{i}b.t", lambda i: f"ax{i}b", lambda i: f"CASE{i}", lambda i: f"b{i}.z", lambda i: f"q.k{i}", lambda i: f"d{i}.ab", lambda i: f"lon{i}ggg", lambda i: f"f.g{i % 60}", lambda i: f"both{i % 40}.q")]
    rules = Ruleset(tuple(made))
    frame = spark.createDataFrame([(n, p + n) for n in sorted(set(names)) for p in ("", "a/", "src/x/", "d5/")], "name string, path string")
    got = {(x["name"], x["path"]): x["o"] for x in frame.select("name", "path", candidate_ordinals(rules, F.col("name"), F.col("path")).alias("o")).collect()}
    patterns = compiled(rules)
    assert got == {k: brute(patterns, *k) for k in got} and sum(map(bool, got.values())) > 500


def test_candidates_are_worked_out_once(spark):
    """No filter below the list of a file's candidates works it out a second time."""
    from stratalog.operators.select import candidates
    from stratalog.rules import builtin_rules

    files = spark.createDataFrame([("", "a/x.py", "x.py", bytearray(b"x")), ("", "a/none", "none", None)], "root string, path string, name string, content binary")
    got = candidates(files, builtin_rules().only("python.cdk.aws_glue_job.python"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("crc32") == 1
    assert [r["path"] for r in got.collect()] == ["a/x.py"]
