"""Constant expressions of HCL: what an expression is worth where no variable and no function is known.

Values are None, bool, Fraction, str, list and dict. Whatever needs a variable, a function or a conversion that does not exist is
Unknown, which makes the whole expression unknown, as does nesting beyond MOST_DEEP.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

MOST_DEEP = 50
#: Binary operators by how tightly they bind.
LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))
_TOKEN = re.compile(
    r"""(?P<skip>[^\S\n]+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<quote>")|(?P<text><<-?(?P<tag>\w+)\n.*?\n?[^\S\n]*(?P=tag)(?=\n|\Z))|(?P<name>[A-Za-z_][\w-]*)"""
    r"""|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<mark>\.\.\.|==|!=|<=|>=|&&|\|\||=>|.|\n)""",
    re.DOTALL,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


class Unknown(Exception):
    """An expression whose value is not constant, or that is no expression."""


def template_end(text: str, i: int) -> int | None:
    """The place after the quoted template that begins at i; quotes and braces inside interpolations nest."""
    open_ = ['"']
    i += 1
    while i < len(text):
        c = text[i]
        if open_[-1] == '"':
            if text.startswith(("$${", "%%{"), i):
                i += 3
            elif text.startswith(("${", "%{"), i):
                open_.append("{")
                i += 2
            elif c == "\n":
                return None
            elif c == '"':
                open_.pop()
                i += 1
                if not open_:
                    return i
            else:
                i += 2 if c == "\\" else 1
        else:
            if c == '"' or c == "{":
                open_.append(c)
            elif c == "}":
                open_.pop()
            i += 1
    return None


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, place): kinds are string, text (heredocs), name, number and mark; an unclosed quote is a mark."""
    out, i = [], 0
    while i < len(text):
        m = _TOKEN.match(text, i)
        kind = "text" if m.lastgroup == "tag" else m.lastgroup
        end = m.end()
        if kind == "quote":
            closed = template_end(text, i)
            kind, end = ("mark", end) if closed is None else ("string", closed)
        if kind != "skip":
            out.append((kind, text[i:end], i))
        i = end
    return out


def shown(v) -> str:
    """A value in a template."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Fraction):
        if v.denominator == 1:
            return str(v.numerator)
        whole = f"{float(v):.17g}"
        short = repr(float(v))
        return short if Fraction(short) == v or len(short) < len(whole) else whole
    if isinstance(v, str):
        return v
    raise Unknown


def number(v) -> Fraction:
    if isinstance(v, Fraction):
        return v
    if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d{1,3})?", v):
        return Fraction(v)
    raise Unknown


def truth(v) -> bool:
    if isinstance(v, bool):
        return v
    if v in ("true", "false"):
        return v == "true"
    raise Unknown


def same(a, b) -> bool:
    """Equality, which holds between values of one type only."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def _divided(a: Fraction, b: Fraction, rest: bool) -> Fraction:
    if not b:
        raise Unknown
    return a - b * int(a / b) if rest else a / b


BINARY: dict[str, Callable] = {
    "||": lambda a, b: truth(a) | truth(b), "&&": lambda a, b: truth(a) & truth(b), "==": same, "!=": lambda a, b: not same(a, b),
    "<": lambda a, b: number(a) < number(b), ">": lambda a, b: number(a) > number(b), "<=": lambda a, b: number(a) <= number(b), ">=": lambda a, b: number(a) >= number(b),
    "+": lambda a, b: number(a) + number(b), "-": lambda a, b: number(a) - number(b), "*": lambda a, b: number(a) * number(b),
    "/": lambda a, b: _divided(number(a), number(b), False), "%": lambda a, b: _divided(number(a), number(b), True),
}


class Expression:
    """A reader of one expression: each method reads from self.i on and returns a function from variables to the value, so
    that the branch that is not taken, and the body of a for over nothing, may be unknown."""

    def __init__(self, found: list[tuple[str, str, int]], deep: int = 0):
        self.t, self.i, self.deep = found, 0, deep

    def at(self, *marks: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] == "mark" and self.t[self.i][1] in marks

    def word(self, name: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][:2] == ("name", name)

    def take(self, mark: str) -> None:
        if not self.at(mark):
            raise Unknown
        self.i += 1

    def name(self) -> str:
        if self.i >= len(self.t) or self.t[self.i][0] != "name":
            raise Unknown
        self.i += 1
        return self.t[self.i - 1][1]

    def lines(self) -> None:
        while self.at("\n"):
            self.i += 1

    def whole(self) -> Callable:
        self.lines()
        got = self.choice()
        self.lines()
        if self.i < len(self.t):
            raise Unknown
        return got

    def choice(self) -> Callable:
        self.deep += 1
        if self.deep > MOST_DEEP:
            raise Unknown
        got = self.binary(0)
        if self.at("?"):
            self.i += 1
            self.lines()
            yes = self.choice()
            self.lines()
            self.take(":")
            self.lines()
            no, test = self.choice(), got
            got = lambda env: _chosen(test, yes, no, env)
        self.deep -= 1
        return got

    def binary(self, level: int) -> Callable:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.at(*LEVELS[level]):
            op = BINARY[self.t[self.i][1]]
            self.i += 1
            right, first = self.binary(level + 1), left
            left = lambda env, op=op, first=first, right=right: op(first(env), right(env))
        return left

    def unary(self) -> Callable:
        turns = []
        while self.at("-", "!"):
            turns.append(self.t[self.i][1])
            self.i += 1
        got = self.steps(self.term())
        for mark in reversed(turns):
            got = (lambda env, x=got: -number(x(env))) if mark == "-" else (lambda env, x=got: not truth(x(env)))
        return got

    def steps(self, got: Callable) -> Callable:
        while self.at(".", "["):
            self.i += 1
            if self.t[self.i - 1][1] == "[":
                self.lines()
                key = self.choice()
                self.lines()
                self.take("]")
            elif self.i < len(self.t) and self.t[self.i][0] == "number":
                places = [Fraction(x) for x in self.t[self.i][1].split(".") if x.isdigit()]  # a.0.1 is read as one number
                self.i += 1
                for p in places[:-1]:
                    got = lambda env, x=got, p=p: _item(x(env), p)
                key = lambda env, p=places[-1]: p
            else:
                key = lambda env, k=self.name(): k
            got = lambda env, x=got, key=key: _item(x(env), key(env))
        return got

    def term(self) -> Callable:
        if self.i >= len(self.t):
            raise Unknown
        kind, text, _ = self.t[self.i]
        self.i += 1
        if kind == "number":
            return lambda env, v=Fraction(text): v
        if kind == "string":
            return template(text[1:-1], self.deep)
        if kind == "text":
            return heredoc(text, self.deep)
        if kind == "name":
            if self.at("("):
                raise Unknown  # a function
            words = {"true": True, "false": False, "null": None}
            return (lambda env: words[text]) if text in words else lambda env: _variable(env, text)
        if text == "(":
            self.lines()
            got = self.choice()
            self.lines()
            self.take(")")
            return got
        if text == "[":
            return self.sequence()
        if text == "{":
            return self.mapping()
        raise Unknown

    def sequence(self) -> Callable:
        self.lines()
        if self.word("for"):
            return self.repeated("]")
        items = []
        while not self.at("]"):
            items.append(self.choice())
            self.lines()
            if not self.at("]"):
                self.take(",")
                self.lines()
        self.i += 1
        return lambda env: [x(env) for x in items]

    def mapping(self) -> Callable:
        self.lines()
        if self.word("for"):
            return self.repeated("}")
        items = []
        while not self.at("}"):
            if self.i + 1 < len(self.t) and self.t[self.i][0] == "name" and self.t[self.i + 1][1] in ("=", ":"):
                key = lambda env, k=self.name(): k
            else:
                key = self.choice()
            if not self.at("=", ":"):
                raise Unknown
            self.i += 1
            self.lines()
            items.append((key, self.choice()))
            if self.at(",", "\n"):
                self.i += 1
            elif not self.at("}"):
                raise Unknown
            self.lines()
        self.i += 1
        return lambda env: {shown(k(env)): v(env) for k, v in items}

    def repeated(self, closing: str) -> Callable:
        """for names in what : value, or key => value, with if and grouping."""
        self.i += 1
        names = [self.name()]
        if self.at(","):
            self.i += 1
            names.append(self.name())
        if self.name() != "in":
            raise Unknown
        source = self.choice()
        self.take(":")
        self.lines()
        first, value, group, test = self.choice(), None, False, None
        self.lines()
        if closing == "}":
            self.take("=>")
            self.lines()
            value = self.choice()
            self.lines()
            if self.at("..."):
                self.i += 1
                group = True
                self.lines()
        if self.word("if"):
            self.i += 1
            test = self.choice()
            self.lines()
        self.take(closing)

        def run(env):
            over = source(env)
            if not isinstance(over, list | dict):
                raise Unknown
            pairs = sorted(over.items()) if isinstance(over, dict) else [(Fraction(i), v) for i, v in enumerate(over)]
            out: list = []
            for k, v in pairs:
                own = env | dict(zip(names, (k, v) if len(names) == 2 else (v,), strict=True))
                if test is None or truth(test(own)):
                    out.append((shown(first(own)), value(own)) if value else first(own))
            if not value:
                return out
            if group:
                return {k: [v for x, v in out if x == k] for k in dict.fromkeys(k for k, _ in out)}
            if len({k for k, _ in out}) < len(out):
                raise Unknown
            return dict(out)

        return run


def _chosen(test: Callable, yes: Callable, no: Callable, env: dict):
    """Results of both branches have one type, so a number or bool beside a string is a string."""
    taken, other = (yes, no) if truth(test(env)) else (no, yes)
    got = taken(env)
    try:
        beside = other(env)
    except Unknown:
        return got
    plain = (bool, Fraction, str)
    if got is None or beside is None or type(got) is type(beside):
        return got
    if isinstance(got, plain) and isinstance(beside, plain) and str in (type(got), type(beside)):
        return shown(got)
    raise Unknown


def _item(v, key):
    if isinstance(v, list):
        i = number(key)
        if i.denominator == 1 and 0 <= i < len(v):
            return v[int(i)]
    elif isinstance(v, dict) and not isinstance(key, list | dict) and key is not None and shown(key) in v:
        return v[shown(key)]
    raise Unknown


def _variable(env: dict, name: str):
    if name not in env:
        raise Unknown
    return env[name]


def template(text: str, deep: int, escapes: bool = True) -> Callable:
    """A template's value: literal parts and interpolations. One interpolation alone keeps its value's type; directives are unknown."""
    parts: list = []
    held, i, trim = "", 0, False

    def literal():
        nonlocal held, trim
        parts.append(held.lstrip() if trim else held)
        held, trim = "", False

    while i < len(text):
        if text.startswith(("$${", "%%{"), i):
            held += text[i + 1 : i + 3]
            i += 3
        elif text.startswith("%{", i):
            raise Unknown
        elif text.startswith("${", i):
            end, depth, j = None, 1, i + 2
            while j < len(text):
                if text[j] == '"':
                    after = template_end(text, j)
                    if after is None:
                        raise Unknown
                    j = after
                    continue
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                if not depth:
                    end = j
                    break
                j += 1
            if end is None or deep >= MOST_DEEP:
                raise Unknown
            inner = text[i + 2 : end]
            if inner.startswith("~"):
                inner, held = inner[1:], held.rstrip()
            literal()
            if inner.endswith("~"):
                inner, trim = inner[:-1], True
            parts.append(Expression(tokens(inner), deep + 1).whole())
            i = end + 1
        elif escapes and text[i] == "\\":
            c = text[i + 1 : i + 2]
            size = {"u": 4, "U": 8}.get(c, 0)
            code = text[i + 2 : i + 2 + size]
            if size and re.fullmatch(f"[0-9a-fA-F]{{{size}}}", code) and int(code, 16) < 0x110000:
                held += chr(int(code, 16))
            elif c in _ESCAPES and c:
                held += _ESCAPES[c]
            else:
                raise Unknown
            i += 2 + size
        else:
            held += text[i]
            i += 1
    literal()
    some = [p for p in parts if p != ""]
    if len(some) == 1 and callable(some[0]):
        return some[0]
    return lambda env: "".join(p if isinstance(p, str) else shown(p(env)) for p in some)


def heredoc(text: str, deep: int) -> Callable:
    head, _, rest = text.partition("\n")
    body = rest[: rest.rindex("\n") + 1] if "\n" in rest else ""
    if head.startswith("<<-"):
        lines = body.split("\n")[:-1]
        cut = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()), default=0)
        body = "".join(x[cut:] + "\n" for x in lines)
    return template(body, deep, escapes=False)


def constant(found: list[tuple[str, str, int]]):
    """The value of an expression's tokens; Unknown where it is not constant."""
    try:
        return Expression(found).whole()({})
    except (RecursionError, OverflowError):
        raise Unknown from None
