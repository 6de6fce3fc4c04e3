"""A small reader of literals in Python, TypeScript and HCL sources.

It cuts a source into tokens, pairs their brackets once, and reads strings, lists, maps and names; every other expression is OTHER, as is
nesting beyond MOST_DEEP. What names were given is indexed once, so that a lookup is a bisection. Nothing is run.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from typing import NamedTuple

from . import hcl

TOKENS = {
    "python": r"""(?P<skip>\s+|\\\n|\#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:'''(?:\\.|.)*?'''|\"\"\"(?:\\.|.)*?\"\"\"|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"))|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>==|.)""",
    "typescript": r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<text>'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>===?|=>|\.\.\.|.)""",
}
_COMPILED = {k: re.compile(v, re.DOTALL) for k, v in TOKENS.items()}
CLOSING = {"(": ")", "[": "]", "{": "}"}
#: Python strings that are their text as it stands.
PLAIN = re.compile(r"""'[^'\\\r\n\0]*'|"[^"\\\r\n\0]*\"""")


class Name(NamedTuple):
    name: str
    at: int


class Other:
    def __repr__(self) -> str:
        return "OTHER"


OTHER = Other()
MOST_DEEP = 100
#: Words that are no names of values; words that stand before or after a name within one TypeScript type.
NOT_NAMES = frozenset("true false null undefined this super".split())
TYPE_WORDS = frozenset("keyof typeof readonly unique infer extends is asserts new abstract".split())


class Source:
    """Tokens (kind, text, place in the text) of a source. Other places are token numbers."""

    def __init__(self, text: str, language: str):
        self.language, self.source = language, text
        if language == "hcl":
            self.tokens = hcl.tokens(text)
        else:
            self.tokens = [(m.lastgroup, m[0], m.start()) for m in _COMPILED[language].finditer(text) if m.lastgroup != "skip"]

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The closing bracket of each opening one; a closing bracket of another kind leaves all that are open without one."""
        out: dict[int, int] = {}
        open_: list[int] = []
        for j, (kind, t, _) in enumerate(self.tokens):
            if kind != "mark":
                continue
            if t in CLOSING:
                open_.append(j)
            elif t in (")", "]", "}") and open_:
                if CLOSING[self.tokens[open_[-1]][1]] == t:
                    out[open_.pop()] = j
                else:
                    open_ = []
        return out

    def close(self, i: int) -> int | None:
        """The place of the bracket that closes the one at i."""
        return self.pairs.get(i)

    def leads(self, i: int) -> bool:
        """Whether token i is the first of its line."""
        before = self.source[self.tokens[i - 1][2] + len(self.tokens[i - 1][1]) if i else 0 : self.tokens[i][2]]
        return "\n" in before or not i

    def ends(self, i: int) -> bool:
        """Whether nothing but blanks follows token i on its line, comments included."""
        end = self.tokens[i][2] + len(self.tokens[i][1])
        stop = self.source.find("\n", end)
        return not self.source[end : len(self.source) if stop < 0 else stop].strip()

    def split(self, i: int, end: int) -> list[tuple[int, int]]:
        """Ranges between the top commas of i..end (in HCL also line ends), without empty ones."""
        out, start = [], i
        while i <= end:
            t = self.text(i) if self.kind(i) == "mark" else ""
            if i == end or t == "," or t == "\n" and self.language == "hcl":
                if i > start:
                    out.append((start, i))
                start = i + 1
            elif t in CLOSING and t:
                i = self.close(i) or end
                continue
            i += 1
        return out

    def string(self, i: int):
        t = self.text(i)
        try:
            if self.language == "python":
                if PLAIN.fullmatch(t):
                    return t[1:-1]
                got = ast.literal_eval(t) if "f" not in t[:2].lower().split("'")[0].split('"')[0] else OTHER
                return got if isinstance(got, str) else OTHER
            if t[0] == "'":  # one character in single quotes counts as a string
                return t[1:-1] if len(t) == 3 else OTHER
            return json.loads(t) if "\\" in t else t[1:-1]
        except (ValueError, SyntaxError):
            return OTHER

    def value(self, i: int, end: int, deep: int = 0):
        """The literal of tokens i..end of a Python source: str, list, dict, a Name, or OTHER. Keys of a dict that are no strings are Names or OTHER."""
        if end - i == 1 and (kind := self.kind(i)) in ("name", "string"):
            return Name(self.text(i), i) if kind == "name" else self.string(i)
        if end > i and all(self.kind(j) == "string" for j in range(i, end)):
            parts = [self.string(j) for j in range(i, end)]
            return OTHER if OTHER in parts else "".join(parts)
        if end <= i or self.text(i) not in CLOSING or self.close(i) != end - 1 or deep > MOST_DEEP:
            return OTHER
        parts = self.split(i + 1, end - 1)
        if self.text(i) == "[":
            return [self.value(a, b, deep + 1) for a, b in parts]
        if self.text(i) == "(":
            return self.value(*parts[0], deep + 1) if len(parts) == 1 and self.text(end - 2) != "," else OTHER
        out: dict = {}
        for a, b in parts:
            pair = self.text(a + 1) == ":" and self.kind(a) in ("string", "name")
            out.setdefault((self.string(a) if self.kind(a) == "string" else Name(self.text(a), a)) if pair else OTHER, self.value(a + 2, b, deep + 1) if pair else OTHER)
        return out

    def after_type(self, i: int) -> int:
        """The place after a declaration's type annotation at i, if it has one: brackets of all kinds are passed as a whole, and
        the annotation ends at its declaration's =, at a comma, semicolon or closing bracket, or where a statement begins."""
        i += self.text(i) == "!"
        if self.text(i) != ":":
            return i
        deep = 0
        while (t := self.text(i)) and not (deep <= 0 and t in ("=", ",", ";")) and t not in (")", "]", "}"):
            if t in CLOSING:
                if (end := self.close(i)) is None:
                    return i
                i = end
            elif t in ("<", ">"):
                deep += 1 if t == "<" else -1
            elif deep <= 0 and self.kind(i) == "name" and t not in TYPE_WORDS and (self.text(i + 1) == "(" or self.kind(i + 1) == "name" and self.text(i + 1) not in TYPE_WORDS):
                return i + 1
            i += 1
        return i

    # Python: names

    @cached_property
    def assignments(self) -> dict[str, list[int]]:
        """By name, the places of the = that give it a value at the beginning of a line, ascending."""
        out: dict[str, list[int]] = {}
        for i, (_, t, _) in enumerate(self.tokens):
            if t in ("=", "==") and self.kind(i - 1) == "name" and self.leads(i - 1):
                out.setdefault(self.text(i - 1), []).append(i)
        return out

    @cached_property
    def given(self) -> dict[int, object]:
        """What names were given, by the place of its first token, as far as it was asked for."""
        return {}

    def assigned(self, name: str, before: int):
        """What a name was given last before a place: a dict, a string, or a name that is alone on its line."""
        places = self.assignments.get(name, [])
        for n in range(bisect_left(places, before - 1) - 1, -1, -1):
            at = places[n] + 1
            if self.text(at) in CLOSING:
                if (end := self.close(at)) is None:
                    continue
                if at not in self.given:
                    self.given[at] = self.value(at, end + 1)
                return self.given[at]
            alone = self.text(at - 1) == "=" and (self.kind(at) == "string" or self.kind(at) == "name" and self.ends(at))
            return self.value(at, at + 1) if alone else OTHER
        return OTHER

    def resolved(self, value, before: int, depth: int = 20):
        """A Name replaced by what it was given last before a place; a name that leads to itself is OTHER."""
        while isinstance(value, Name) and depth:
            value, depth = self.assigned(value.name, before), depth - 1
        return OTHER if isinstance(value, Name) else value

    # TypeScript: expressions are ranges of tokens, whose kind decides

    def expression(self, a: int, b: int) -> str:
        """The kind of tokens a..b: object, string, identifier or other (calls, as and satisfies, brackets, templates ...)."""
        if b - a == 1:
            if self.kind(a) == "name":
                return "other" if self.text(a) in NOT_NAMES else "identifier"
            return "string" if self.kind(a) == "string" or self.text(a)[:1] == "'" else "other"
        return "object" if b > a and self.text(a) == "{" and self.close(a) == b - 1 else "other"

    def expression_end(self, i: int) -> int:
        """Where the expression at i ends: at a comma, a semicolon or a closing bracket, or at a line that cannot go on with it."""
        start = i
        while i < len(self.tokens):
            kind, t, _ = self.tokens[i]
            if kind == "mark" and t in (",", ";", ")", "]", "}"):
                break
            if i > start and kind in ("name", "number", "string") and t not in ("in", "instanceof") and self.leads(i) and (self.kind(i - 1) != "mark" or self.text(i - 1) in (")", "]", "}")):
                break
            i = (self.close(i) or len(self.tokens) - 1) + 1 if kind == "mark" and t in CLOSING else i + 1
        return i

    @cached_property
    def declared(self) -> dict[tuple[str, str], tuple[list[int], list[int]]]:
        """By name and kind of expression, the ends and begins of what const, let and var give it, by end."""
        out: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, (kind, t, _) in enumerate(self.tokens):
            if kind != "name" or t not in ("const", "let", "var") or self.text(i - 1) == ".":
                continue
            at = i + 1
            while at < len(self.tokens):
                name = self.text(at) if self.kind(at) == "name" else None
                eq = self.after_type((self.close(at) or at) + 1 if self.text(at) in ("{", "[") else at + 1)
                if self.text(eq) != "=":
                    end = eq
                else:
                    end = self.expression_end(eq + 1)
                    if name:
                        out.setdefault((name, self.expression(eq + 1, end)), []).append((end, eq + 1))
                if self.text(end) != ",":
                    break
                at = end + 1
        return {k: tuple(map(list, zip(*sorted(v), strict=True))) for k, v in out.items()}

    def found(self, a: int, b: int, kind: str) -> tuple[int, int] | None:
        """The range of an expression of a kind: tokens a..b themselves, or what the name they are was given last before them among expressions of that kind."""
        own = self.expression(a, b)
        if own == kind:
            return a, b
        if own != "identifier":
            return None
        ends, begins = self.declared.get((self.text(a), kind), ([], []))
        n = bisect_right(ends, a) - 1
        return (begins[n], ends[n]) if n >= 0 else None

    def member(self, a: int, b: int, key: str) -> tuple[int, int] | None:
        """The range of the value of the first pair with a key in the object of tokens a..b."""
        for x, y in self.split(a + 1, b - 1):
            if self.text(x + 1) == ":" and (self.kind(x) == "name" and self.text(x) == key or self.kind(x) in ("string", "text") and self.text(x)[0] != "`" and self.string(x) == key):
                return x + 2, y
        return None

    def string_of(self, a: int, b: int) -> str | None:
        place = self.found(a, b, "string")
        value = self.string(place[0]) if place else OTHER
        return value if isinstance(value, str) else None
