"""Globs and document paths, compiled once to regular expressions.

A place in a document is written as a string: K and a key, or I and an eight-digit index, per step. Places sort in
the documents' order of visiting: keys bytewise, items by index.
"""

from __future__ import annotations

import re

K, I = "\x1f", "\x1e"
ITEM = I + r"\d{8}"
ANY_KEY = f"{K}[^{K}{I}]*"


def key(name: str) -> str:
    return K + re.sub(r"([^A-Za-z0-9_\x1f\x1e])", r"\\\1", name)


def glob_problem(glob: str) -> str | None:
    """What is wrong with a path glob, or None."""
    for segment in glob.split("/"):
        if segment == "":
            return "empty segment"
        if "**" in segment and segment != "**":
            return "** must be a whole segment"
        try:
            if segment != "**":
                re.compile(_segment(segment))
        except (re.error, IndexError, ValueError):
            return "syntax error in pattern"
    return None


def _segment(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = text.index("]", i + 2)
            body = text[i + 1 : end]
            negate = body.startswith("^")
            body = body.removeprefix("^")
            if not body or body.startswith("-") or body.endswith("-"):
                raise ValueError(body)
            out.append(("[^" if negate else "[") + body.replace("[", r"\[").replace("&&", r"&\&") + "]")
            i = end
        elif c == "\\":
            out.append(re.escape(text[i + 1]))
            i += 1
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """A regular expression for whole slash paths; ** stands for any number of whole segments."""
    segments = glob.split("/")
    if segments == ["**"]:
        return r"(?s)\A.*\z"
    out = r"\A"
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            if last:
                out = out.removesuffix("/") + "(?:/[^/]*)*"
            else:
                out += "(?:[^/]*/)*"
        else:
            out += _segment(segment) + ("" if last else "/")
    return out + r"\z"


def path_steps(query: str, wildcard: bool = False, lists: bool = True) -> list[tuple[str, bool]]:
    """(key, whether its items are visited) per step of a.b[].c; '*' is any key where wildcard allows it. ValueError says what is wrong."""
    if query == "":
        raise ValueError("required")
    steps = []
    for part in query.split("."):
        each = part.endswith("[]")
        name = part[:-2] if each else part
        if name == "":
            raise ValueError("empty path segment")
        if "[" in name or "]" in name or each and not lists:
            raise ValueError("only a trailing [] is supported")
        if "*" in name and not (wildcard and name == "*"):
            raise ValueError("* must be a whole segment" if wildcard else "* is not supported")
        steps.append((name, each))
    return steps


def path_regex(query: str, wildcard: bool = False) -> str:
    return "^" + "".join((ANY_KEY if name == "*" and wildcard else key(name)) + (ITEM if each else "") for name, each in path_steps(query, wildcard)) + r"\z"
