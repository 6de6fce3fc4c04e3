"""Constant expressions of HCL, and the Terraform and Python readers that use literals."""

import random
import time
from fractions import Fraction

import pytest

from stratalog.functions import hcl
from stratalog.functions.literals import OTHER, Source
from stratalog.operators.source_code import match_python, match_terraform

RULE = {"resource_type": "aws_glue_job", "conditions": [{"path": "args.--language", "equals": "python"}, {"path": "args.--modules", "present": True}]}


def value(text):
    try:
        return hcl.constant(hcl.tokens(text))
    except hcl.Unknown:
        return "unknown"


@pytest.mark.parametrize("text, want", [
    ('"python"', "python"), ('"${"python"}"', "python"), ('"py${"th"}on"', "python"), ('"${1}"', 1), ('"v${1 + 2}"', "v3"), ('"${true}-${1.5}"', "true-1.5"), ('"$${a}"', "${a}"), ('"a\\n\\u00e9\\"b"', 'a\né"b'),
    ('"${ {a = "}"}["a"] }x"', "}x"), ('"a ${~ "b" ~} c"', "abc"), ('"%{ if true }a%{ endif }"', "unknown"), ('"\\q"', "unknown"), ('"a${null}"', "unknown"),
    ('true ? "python" : "scala"', "python"), ("1 > 2 ? 1 : 2", 2), ('true ? 1 : "x"', "1"), ("false ? var.a : 3", 3), ("true ? var.a : 3", "unknown"), ("true ? [1] : 3", "unknown"),
    ('["python"][0]', "python"), ('["a", "b",][1]', "b"), ('[["a"]].0.0', "a"), ('{a = {b = "c"}}.a.b', "c"), ('{"x y" = 1}["x y"]', 1), ("[1][2]", "unknown"), ("[1][0.5]", "unknown"), ("null.a", "unknown"),
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("7 % 4 - -1", 4), ("-7 % 4", -3), ("1 / 3 * 3", 1), ("1 / 0", "unknown"), ('"2" + 1', 3), ('"x" + 1', "unknown"), ("1e2", 100), ("!false && (1 == 2 || 2 >= 2)", True),
    ('"1" == 1', False), ("[1, 2] == [1, 2]", True), ("null == null", True), ("1 != 2", True), ("2 - 3 - 4", -5),
    ("[for x in [1, 2, 3] : x * 2 if x > 1]", [4, 6]), ('{for k, v in {b = 1, a = 2} : "${k}!" => v}', {"a!": 2, "b!": 1}), ("{for i, v in [1, 2, 1] : v => i...}", {"1": [0, 2], "2": [1]}), ("{for v in [1, 1] : v => v}", "unknown"), ("[for x in [] : var.y]", []),
    ("var.a", "unknown"), ('upper("a")', "unknown"), ("", "unknown"), ("1 2", "unknown"), ("[1", "unknown"), ("{a = 1\n b = 2,\n}", {"a": 1, "b": 2}), ("[\n1,\n# note\n2\n]", [1, 2]), ("{(\"a\") = 1}", {"a": 1}),
    ("<<EOT\n a\n b\nEOT", " a\n b\n"), ("<<-EOT\n   a\n  b${1}\n  EOT", " a\nb1\n"), ("null", None), ("[" * 5000 + "]" * 5000, "unknown"), ("+".join(["1"] * 5000), "unknown"), ("-" * 3 + "1", -1),
])
def test_constants(text, want):
    got = value(text)
    assert got == want and isinstance(got, bool) == isinstance(want, bool), text


def test_arithmetic_against_python():
    """Random expressions of whole numbers, with the same priorities as Python's."""
    r = random.Random(3)

    def made(deep):
        if not deep or r.random() < 0.2:
            return str(r.randint(0, 9))
        if r.random() < 0.3:
            return f"({made(deep - 1)})"
        return f"{made(deep - 1)} {r.choice('+-*')} {made(deep - 1)}"

    for _ in range(300):
        text = made(5)
        assert value(text) == Fraction(eval(text))  # digits, brackets and + - * only


def terraform(args, rest=""):
    return match_terraform(f'resource "aws_glue_job" "x" {{\n  name = "a"\n  args = {args}\n  timeouts {{\n    create = "1h"\n  }}\n}}\n{rest}', RULE)[0]


@pytest.mark.parametrize("args, want", [
    ('{ "--language" = "${"python"}", "--modules" = "a" }', True), ('{\n "--language" = true ? "python" : "scala"\n "--modules" = "a"\n n = 1 + 2\n }', True), ('{ "--language" = ["python"][0], "--modules" = [for x in ["a"] : x] }', True),
    ('{ "--language" = "python", "--modules" = var.a }', False), ('{ "--language" = "python", "--modules" = "a", n = upper("b") }', False), ('{ "--language" = "python", "--modules" = null }', False), ('{ "--language" = 1 == 1 ? "python" : var.x, "--modules" = 0 }', True),
    ('{for k, v in {language = "python", modules = "a"} : "--${k}" => v}', True), ('merge({}, { "--language" = "python", "--modules" = "a" })', False), ('{ "--language" = "py" == "py", "--modules" = "a" }', False),
])
def test_terraform(args, want):
    assert terraform(args) is want
    assert terraform(args, 'variable "v" {}\n') is want


CDK = {"cdk_construct": {"module": "aws_cdk.aws_glue", "construct": "CfnJob", "keyword_argument": "default_arguments", "conditions": [{"key": "--language", "equals": "python"}], "extract": {"key": "--modules", "split": "comma"}}}
PY = "from aws_cdk import aws_glue as g\n"


@pytest.mark.parametrize("body, deps", [
    ('g.CfnJob(default_arguments={"--language": "python", "--modules": "a,b"})', ["a", "b"]),
    ('A = B\nB = "python"\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', ["a"]),  # names are looked up from the call
    ('K = "--language"\nargs = {K: "python", "--modules": "a"}\ng.CfnJob(default_arguments=args)', ["a"]),
    ('A = "python"\nrun(A="scala")\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', ["a"]),  # not at the beginning of a line
    ('A = "python"\nA = B + C\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', None),
    ('A = B  # note\nB = "python"\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', None),
    ('A = A\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', None), ('g.CfnJob(default_arguments={"--language": A, "--modules": "a"})\nA = "python"', None),
    ('A = "python"\nif x:\n    A = "scala"\ng.CfnJob(default_arguments={"--language": A, "--modules": "a"})', None),
    ('g.CfnJob(default_arguments={"--language": "scala", "--language": "python", "--modules": "a"})', None),
])
def test_python_names(body, deps):
    assert match_python(PY + body, CDK) == ((deps is not None), deps or [], None)


def test_lookups_against_a_walk_back():
    """The index of assignments gives what a walk over all lines gives."""
    r = random.Random(5)
    lines = []
    for _ in range(400):
        n = r.choice("abcd")
        lines.append(r.choice([f'{n} = "{r.randint(0, 99)}"', f"{n} = {r.choice('abcd')}", f"use({n}='no')", f"  {n} = {{'k': '{r.randint(0, 99)}'}}", f"{n} = 1 + 1", f"x.{n} = 'no'"]))
    s = Source("\n".join(lines), "python")
    firsts = [i for i in range(len(s.tokens)) if s.leads(i)]
    for at in range(0, 400, 7):
        for name in "abcd":
            want = OTHER
            for k in range(at):
                head, _, tail = lines[k].strip().partition(" = ")
                if head == name:
                    want = tail
            got = s.assigned(name, firsts[at])
            plain = want if want is OTHER else eval(want, {c: c for c in "abcd"}) if "+" not in want else OTHER
            assert (got.name if isinstance(got, tuple) else got) == plain


def test_python_time_is_linear():
    def took(n):
        text = PY + "".join(f'v{i} = "scala"\ng.CfnJob(default_arguments={{"--language": v{i % 5}, "--modules": w}})\n' for i in range(n))
        began = time.perf_counter()
        assert not match_python(text, CDK)[0]
        return time.perf_counter() - began

    took(50)
    assert took(4000) < 8 * 4 * max(took(500), 0.05)


def test_deep_python_is_no_error():
    deep = "[" * 5000 + "]" * 5000
    assert match_python(f"{PY}x = {deep}\ng.CfnJob(default_arguments={{'--language': 'python', '--modules': {deep}}}, y={deep})", CDK) == (False, [], None)
