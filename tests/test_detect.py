import pytest

from pyspark.sql import functions as F

from cases import CASES
from stratalog.operators.select import selector_type
from stratalog.plans import views
from stratalog.plans.detect import detect
from stratalog.plans.report import json_report, text_report
from stratalog.rules import RuleError, builtin_rules, parse_rules

FILES = "root string, path string, name string, content binary"


def files(spark, rows):
    return spark.createDataFrame([(root, path, path.rpartition("/")[2], bytearray(text.encode())) for root, path, text in rows], FILES)


@pytest.fixture(scope="module")
def found(spark):
    rows = files(spark, [(root, path, text) for root, (path, text, *_) in CASES.items()])
    return {r["root"]: r for r in detect(rows, on_error="warn").collect()}


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    path, _, kind, has, raws = CASES[case]
    got = found.get(case)
    if kind is None:
        assert got is None
        return
    assert (got["path"], got["type"], got["has_dependencies"], [d["raw"] for d in got["dependencies"] or []]) == (path, kind, has, raws)
    assert bool(got["warnings"]) == (case.startswith("bad ") and "after" not in case or case == "array json")


def test_fields(found):
    deps = {k: [{f: v for f, v in d.asDict().items() if v is not None} for d in found[k]["dependencies"]] for k in ("cargo lock", "poetry", "requirements", "pyproject", "npm 3", "pnpm", "composer", "go", "uv", "pipfile lock")}
    assert deps["cargo lock"] == [
        {"raw": "serde@1.0.217", "name": "serde", "version": "1.0.217", "source": "registry", "extras": {"checksum": "abc", "source_url": "https://r"}},
        {"raw": "g@1", "name": "g", "version": "1", "source": "git", "extras": {"source_url": "https://g", "source_ref": "f"}},
    ]
    assert deps["poetry"][1] == {"raw": "lib", "name": "lib", "source": "git", "extras": {"source_url": "https://g/x", "source_ref": "main"}}
    assert deps["requirements"][1] == {"raw": 'uvicorn[standard]>=0.30 ; python_version >= "3.11"', "name": "uvicorn", "constraint": '[standard]>=0.30 ; python_version >= "3.11"'}
    assert deps["pyproject"][3] == {"raw": "pytest>=8", "name": "pytest", "constraint": ">=8", "section": "project.optional-dependencies.dev"}
    assert deps["pyproject"][6] == {"raw": 'fastapi = "^0.1"', "section": "tool.poetry.dependencies"}
    assert [d.get("section") for d in deps["npm 3"]] == ["devDependencies", "dependencies", "dependencies"]
    assert deps["pnpm"][:2] == [{"raw": "react@18.3.1", "name": "react", "version": "18.3.1", "section": "dependencies", "extras": {"specifier": "^18.3.1"}}, {"raw": "only@^2", "name": "only", "constraint": "^2", "section": "devDependencies"}]
    assert deps["composer"][0]["extras"] == {"package_type": "library"} and deps["composer"][2]["section"] == "packages-dev"
    assert deps["go"][0] == {"raw": "github.com/a/b", "name": "github.com/a/b", "version": "v1.9.0", "section": "indirect"}
    assert deps["uv"][1] == {"raw": "lib", "name": "lib", "source": "path"}
    assert deps["pipfile lock"][1] == {"raw": "requests==2.32.3", "name": "requests", "version": "2.32.3", "section": "default"}


def test_includes(spark):
    rows = [
        ("/r", "requirements.txt", "a==1\n-r extras/dev.in.x\n--requirement=missing.txt\nb\n-r again.x"), ("/r", "extras/dev.in.x", "c\n-r ../again.x\n"), ("/r", "again.x", "d\n-r requirements.txt"),
        ("/r", "x/requirements.txt", "-r gone"),
    ]
    got = {r["path"]: r for r in detect(files(spark, rows), builtin_rules().only("python-requirements")).collect()}
    assert [d["raw"] for d in got["requirements.txt"]["dependencies"]] == ["a==1", "c", "d", "b", "d"]
    assert got["requirements.txt"]["warnings"] == [
        'detected requirements include cycle for "/r/requirements.txt" via "requirements.txt"',
        'could not read included requirements file "missing.txt": open /r/missing.txt: no such file or directory',
        'detected requirements include cycle for "/r/requirements.txt" via "requirements.txt"',
    ]
    assert got["x/requirements.txt"]["has_dependencies"] is None and got["x/requirements.txt"]["dependencies"] is None


def test_errors_end_the_job(spark):
    with pytest.raises(Exception, match="detection failed"):
        detect(files(spark, [("", "package.json", "{")])).collect()
    assert detect(files(spark, [("", "package.json", "{")]), on_error="skip").count() == 0


def test_empty_and_odd_tables(spark):
    assert detect(files(spark, [])).count() == 0
    odd = spark.createDataFrame([("", None, None, None), ("", "requirements.txt", None, None), ("", "go.sum", None, None)], FILES)
    assert {(r["path"], r["has_dependencies"]) for r in detect(odd).collect()} == {("requirements.txt", False), ("go.sum", None)}


def test_views_and_reports(spark, tmp_path):
    rows = files(spark, [("/r", "go.mod", "module x\nrequire a v1 // indirect\nrequire b v2\n"), ("/r", "go.sum", ""), ("/r", "package.json", "{}"), ("/r", "bower.json", '{"dependencies": {"a": 1}}'), ("/r", "requirements.txt", "x\n-r no\n")])
    got = detect(rows).cache()
    assert {r["status"]: r["manifests"] for r in views.summary(got).collect()} == {"extracted": 2, "unknown": 1, "empty": 1, "present-not-extracted": 1}
    assert "".join(text_report(got, "/r")) == (
        "Root: /r\n\nFound 5 manifests:\n- 2 with extracted dependencies\n- 1 confirmed empty\n- 1 with dependencies present, not extracted\n- 1 with dependency status unknown\n"
        "\nbower.json [dependencies present, not extracted]\n\ngo.mod [2 deps]\n  indirect:\n    - a@v1\n  [default group]\n    - b@v2\n\ngo.sum [matched]\n"
        '\nrequirements.txt [1 dep]\n  - x\n  warning: could not read included requirements file "no": open /r/no: no such file or directory\n'
    )
    assert '"path": "go.sum",\n      "has_dependencies": null' in json_report(got, "/r")
    assert json_report(got.limit(0), "/r") == '{\n  "root": "/r",\n  "manifests": null\n}\n'
    assert [(r["section"], r["displays"]) for r in views.sections(got).where("path = 'go.mod'").orderBy("first_pos").collect()] == [("indirect", ["a@v1"]), ("[default group]", ["b@v2"])]
    assert {r["name"]: r["manifests"] for r in views.package_usage(got).collect()} == {"a": 1, "b": 1, "x": 1}


CUSTOM = r"""
rules:
  - {name: leaves, filename-regex: '\.yaml$', yaml: {query: 'a.b[].c'}}
  - {name: any, filename-regex: '\.toml$', toml: {exists-any: [x.*.y], table-exists-any: [q]}}
  - {name: tables, filename-regex: '\.tml$', toml: {table-queries: ['*'], queries: ['l[]']}}
  - {name: bare, path-glob: 'x/**/y?.[a-c]'}
"""


def test_custom_rules(spark):
    rows = [("", "a.yaml", "a:\n  b:\n  - {c: one}\n  - {c: 2}\n  - {c: ''}\n  - {c: two}\n"), ("", "b.yaml", "a: 1"), ("", "a.toml", "[x.k]\ny = 0\n"), ("", "b.toml", "[q]\nr = 1\n"), ("", "a.tml", 'l = ["p>=1", "a = b"]\n[t]\nz = 1.5\nd = 1979-05-27\n'), ("", "x/y1.b", ""), ("", "x/p/q/y1.c", ""), ("", "x/y12.b", "")]
    got = {r["path"]: (r["type"], r["has_dependencies"], [(d["raw"], d["name"], d["section"]) for d in r["dependencies"] or []]) for r in detect(files(spark, rows), parse_rules(CUSTOM)).collect()}
    assert got == {
        "a.yaml": ("leaves", True, [("one", None, None), ("two", None, None)]), "a.toml": ("any", True, []), "b.toml": ("any", False, []),
        "a.tml": ("tables", True, [("p>=1", "p", "l"), ("a = b", None, "l"), ("z = 1.5", None, "t")]), "x/y1.b": ("bare", None, []), "x/p/q/y1.c": ("bare", None, []),
    }


@pytest.mark.parametrize("text, message", [
    ("rules: []", "must contain at least one rule"), ("rules: [{filename-regex: x}]", r"rules\[0\].name: required"), ("rules: [{name: x}]", "at least one selector"), ("rules: [{name: x, filename-regex: '('}]", "filename-regex: compile"),
    ("rules: [{name: x, path-glob: 'a**'}]", "path-glob"), ("rules: [{name: x, path-glob: 'a//b'}]", "empty segment"), ("rules: [{name: x, filename-regex: x, uv-lock: {}, go-mod: {}}]", "at most one parser"),
    ("rules: [{name: x, filename-regex: x, yaml: {query: 'a..b'}}]", "yaml.query"), ("rules: [{name: x, filename-regex: x, toml: {queries: ['a*']}}]", "toml.queries"), ("rules: [{name: x, filename-regex: x, xml: {exists-any: ['a[]']}}]", "xml.exists-any"),
    ("rules: [{name: x, filename-regex: x, html: {external_scripts: false}}]", "must be true"), ("rules: [{name: x, filename-regex: x, ini: {queries: [{section: a, key: 'a*'}]}}]", "stand alone"), ("rules: [{name: x, filename-regex: x, banner-regex: 'a'}]", "two groups"),
])
def test_rule_errors(text, message):
    with pytest.raises(RuleError, match=message):
        parse_rules(text)


def test_rule_blocks():
    assert len(builtin_rules().rules) == 95 and builtin_rules().types[0] == "python-requirements"
    assert parse_rules("rules: [{name: x, filename-regex: x, uv-lock: }]").rules[0].parser is None


def test_strict_go_mod(spark):
    """Unknown directives and blocks, and brackets without their other half, fail the file."""
    texts = {
        "bogus y\n": "unknown directive: bogus", "module m\nthings (\n\tx\n)\n": "unknown block type: things", "module m\n)\n": "unexpected )", "module m\nrequire (\n\ta.b/c v1.0.0\n": "unclosed block: require",
        "go (\n\t1.22\n)\n": "unknown block type: go", "module m // note\n\ngo 1.22\ntoolchain go1.22.1\nrequire a.b/c v1.0.0\nretract v1\nexclude (\n\tx.y/z v1.0.0\n)\ntool x.y/t\n": None,
    }
    rows = files(spark, [(str(i), "go.mod", t) for i, t in enumerate(texts)])
    got = {int(r["root"]): r["warnings"] for r in detect(rows, builtin_rules().only("go-mod"), on_error="warn").collect()}
    assert got == {i: [e] if e else None for i, e in enumerate(texts.values())}


def test_names_alone(spark):
    """Rules without a reader answer for names; readers and path globs do not."""
    rules = parse_rules("rules:\n- {name: globbed, path-glob: 'x/*.k'}\n- {name: read, filename-regex: '^go[.]mod$', go-mod: {}}\n- {name: sum, filename-regex: '[.]sum$'}\n- {name: late, filename-regex: '^go[.]'}\n")
    table = spark.createDataFrame([("", n, f"x/{n}", bytearray(b"")) for n in ("go.sum", "go.mod", "a.k", "other")], "root string, name string, path string, content binary")
    assert {r["name"]: r["t"] for r in table.select("name", selector_type(rules, F.col("name")).alias("t")).collect()} == {"go.sum": "sum", "go.mod": "late", "a.k": None, "other": None}
    of = lambda t, **o: {r["path"]: r["type"] for r in detect(t, rules, on_error="skip", **o).collect()}
    assert of(table) == {"x/go.sum": "sum", "x/go.mod": "read", "x/a.k": "globbed"} and of(table, globs=False) == {"x/go.sum": "sum", "x/go.mod": "read"}
    bare = spark.createDataFrame([(n, n, "", bytearray(b"module m\n")) for n in ("go.sum", "package.json")], "root string, name string, path string, content binary")
    assert [(r["root"], r["type"]) for r in detect(bare).collect()] == [("go.sum", "go-sum")]


def test_repeated_rows(spark):
    """A path that is given twice counts once."""
    rows = files(spark, [("", "requirements.txt", "a\na\nb")] * 2)
    assert [[d["raw"] for d in r["dependencies"]] for r in detect(rows, builtin_rules().only("python-requirements")).collect()] == [["a", "a", "b"]]


def test_later_candidates_of_matched_files_are_not_read(spark, monkeypatch):
    """First match in stages: a rule's reader sees only files that no earlier one took, and an error of a later rule never shows."""
    from stratalog.plans import detect as module

    rules = parse_rules("""
rules:
- {name: query, filename-regex: '[.]yaml$', yaml: {query: 'a.b'}}
- {name: listed, filename-regex: '^req.*', py-requirements: {}}
- {name: mod, filename-regex: '^x.*', go-mod: {}}
- {name: strict, filename-regex: '[.](yaml|txt)$', json: {exists-any: [a]}}
- {name: rest, filename-regex: '^x.*'}
""")
    rows = [("r", "p/x1.yaml", "a: {b: hit}"), ("r", "q/x2.yaml", "a: {c: no}"), ("r", "req.txt", "one"), ("r", "x3.txt", "module m\n"), ("r", "plain.txt", '{"a": 1}'), (None, "x4.yaml", "a: {b: hit}"), ("r", "y.yaml", '{"a": 2}')]
    seen = []
    real = module.outcomes
    monkeypatch.setattr(module, "outcomes", lambda rows, *more: (seen.append(sorted((r["path"], r["ordinal"]) for r in rows.select("path", "ordinal").collect())), real(rows, *more))[1])
    got = {(r["root"], r["path"]): r["type"] for r in detect(files(spark, rows), rules, on_error="skip").collect()}
    assert got == {("r", "p/x1.yaml"): "query", ("r", "q/x2.yaml"): "rest", ("r", "req.txt"): "listed", ("r", "x3.txt"): "mod", ("r", "plain.txt"): "strict", ("", "x4.yaml"): "query", ("r", "y.yaml"): "strict"}
    ordinals = sorted(r.ordinal for r in rules.rules)
    assert len(seen) == 4 and seen[0] == sorted([("p/x1.yaml", ordinals[0]), ("q/x2.yaml", ordinals[0]), ("req.txt", ordinals[1]), ("x3.txt", ordinals[2]), ("plain.txt", ordinals[3]), ("x4.yaml", ordinals[0]), ("y.yaml", ordinals[0])])
    assert {p for stage in seen[1:] for p, _ in stage} == {"q/x2.yaml", "y.yaml"}
    fails = {r["path"]: r["warnings"] for r in detect(files(spark, rows[:1] + rows[2:4]), rules, on_error="fail").collect()}
    assert set(fails.values()) == {None}
