"""TypeScript sources: declarations and imports of any length, kinds of expressions, time."""

import time

import pytest

from stratalog.functions.literals import Source
from stratalog.operators.source_code import match_typescript, typescript_names

RULE = {"cdk_construct": {"module": "aws-cdk-lib/aws-glue", "construct": "CfnJob", "props_argument_index": 2, "within": ["defaultArguments"],
    "conditions": [{"key": "--modules", "present": True}, {"key": "--language", "equals": "python"}], "extract": {"key": "--modules", "split": "comma"}}}
HEAD = 'import * as g from "aws-cdk-lib/aws-glue";\nimport { CfnJob as Job } from "aws-cdk-lib/aws-glue";\n'
ARGS = '{ "--language": "python", "--modules": "a, b" }'


def test_long_annotations():
    for kind in ("Record<string, Record<string, string | number>>", "{ a: string; b: { c: number; d?: string[] }; e: Map<string, number> }", "(a: string, b: number) => Record<string, string>", "string"):
        for end in ("", ";"):
            s = Source(f'const args: {kind} = "x"{end}\nuse(args)', "typescript")
            assert s.string_of(len(s.tokens) - 2, len(s.tokens) - 1) == "x", kind
    s = Source('let a: string\nrun(1)\nb = "y"\nuse(a)', "typescript")
    assert s.string_of(len(s.tokens) - 2, len(s.tokens) - 1) is None


def test_long_imports():
    names = ", ".join(f"N{i}" for i in range(300))
    s = Source(f'import "side"\nimport x from "y";\nimport {{ from, {names}, Job as J }} from "m";', "typescript")
    assert typescript_names(s, "m", "Job") == (set(), {"J"})


@pytest.mark.parametrize("body, deps", [
    (f"new g.CfnJob(this, 'x', {{ defaultArguments: {ARGS} }})", ["a", "b"]),
    (f"new Job(this, 'x', {{ 'defaultArguments': 1, defaultArguments: {ARGS} }})", ["a", "b"]),  # single quotes are no key
    (f"const p = {{ defaultArguments: {ARGS} }}\nnew g.CfnJob(this, 'x', p)", ["a", "b"]),
    (f"const p: Props = {{ defaultArguments: {ARGS} }};\nnew g.CfnJob<A<B>>(this, 'x', p, 4)", ["a", "b"]),
    ('const l = "python", m = "x,,y"\nnew Job(this, "x", { defaultArguments: { "--language": l, "--modules": m } })', ["x", "y"]),
    (f"const p = {{ defaultArguments: {ARGS} }} as const;\nnew g.CfnJob(this, 'x', p)", None),
    (f"const p = {{ defaultArguments: {ARGS} }} satisfies Props\nnew g.CfnJob(this, 'x', p)", None),
    (f"const p = ({{ defaultArguments: {ARGS} }})\nnew g.CfnJob(this, 'x', p)", None),
    (f"new g.CfnJob(this, 'x', ({{ defaultArguments: {ARGS} }}))", None),
    (f"new g.CfnJob(this, 'x', {{ defaultArguments: {ARGS} }} as any)", None),
    (f"const a = {ARGS}\nnew g.CfnJob(this, 'x', {{ defaultArguments: a }})", None),  # within asks for objects themselves
    (f"const defaultArguments = {ARGS}\nnew g.CfnJob(this, 'x', {{ defaultArguments }})", None),  # no pair
    (f"const o = {{ defaultArguments: {ARGS} }}\nnew g.CfnJob(this, 'x', {{ ...o }})", None),
    (f"let p = {{ defaultArguments: {ARGS} }}\nlet q = p\nnew g.CfnJob(this, 'x', q)", None),  # one name at most
    (f"const p = {{ defaultArguments: {ARGS} }}\nfunction f() {{ const p = load() }}\nnew g.CfnJob(this, 'x', p)", ["a", "b"]),  # the last object counts
    (f"new g.CfnJob(this, 'x', p)\nconst p = {{ defaultArguments: {ARGS} }}", None),  # given later
    (f"p = {{ defaultArguments: {ARGS} }}\nnew g.CfnJob(this, 'x', p)", None),  # no declaration
    (f"new a.g.CfnJob(this, 'x', {{ defaultArguments: {ARGS} }})", None), (f"new g.Other(this, 'x', {{ defaultArguments: {ARGS} }})", None),
    (f"new g.CfnJob(this, {{ defaultArguments: {ARGS} }})", None), (f"g.CfnJob(this, 'x', {{ defaultArguments: {ARGS} }})", None),
    ("new Job(this, 'x', { defaultArguments: { '--language': 'python', \"--modules\": \"a\" } })", None),
    ('new Job(this, "x", { defaultArguments: { "--language": `python`, "--modules": "a" } })', None),
    ('new Job(this, "x", { defaultArguments: { "--language": "python", "--modules": f() } })', []),
    (f'new Job(this, "x", {{ defaultArguments: {{ "--language": "python", "--modules": "one" }}, more: new Job(this, "y", {{ defaultArguments: {ARGS} }}) }})', ["one"]),
    (f'new Job(this, "x", {{ defaultArguments: {{ "--language": "python", "--modules": "one" }} }})\nnew Job(this, "y", {{ defaultArguments: {ARGS} }})', ["a", "b"]),
    ('const l = "scala"\nconst l = "python" + ""\nnew Job(this, "x", { defaultArguments: { "--language": l, "--modules": "a" } })', None),
])
def test_kinds_of_expressions(body, deps):
    assert match_typescript(HEAD + body, RULE) == ((deps is not None), deps or [], None)


def test_time_is_linear():
    """Thousands of calls over thousands of names; deep nesting is no error."""

    def took(n):
        body = "".join(f'const p{i} = {{ defaultArguments: {ARGS} }}\nnew g.CfnJob(this, "x{i}", p{i % 7})\n' for i in range(n))
        began = time.perf_counter()
        assert match_typescript(HEAD + body, RULE)[0]
        return time.perf_counter() - began

    took(50)
    assert took(4000) < 8 * 4 * max(took(500), 0.05)
    assert match_typescript(HEAD + "const a = " + "[" * 20_000 + "]" * 20_000 + f"\nnew Job(1, 2, {{ defaultArguments: {ARGS} }})", RULE)[0]
