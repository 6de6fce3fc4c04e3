"""Literals of Python sources."""

import ast

import pytest

from stratalog.functions import literals
from stratalog.functions.literals import OTHER, Source

PLAIN = ["'a'", '"b, c"', "''", '""', "'o\"o'", '"é"', "'f{x}'"]
ODD = ["'a\\n'", r"r'\d'", "u'x'", "'''a\nb'''", '""""""', "'a\rb'", "'a\0b'", "f'{x}'", "b'x'"]


@pytest.mark.parametrize("text", PLAIN + ODD)
def test_python_strings(monkeypatch, text):
    """Every string is what Python makes of it, those that are their text as it stands without being parsed."""
    try:
        want = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        want = OTHER
    s, real, parsed = Source(text, "python"), ast.literal_eval, []
    monkeypatch.setattr(literals.ast, "literal_eval", lambda t: parsed.append(t) or real(t))
    assert len(s.tokens) == 1 and s.string(0) == (want if isinstance(want, str) else OTHER)
    assert not (parsed and text in PLAIN)
