"""Text expressions that the readers share. All are columns, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode's included.
EDGE = r"^[\s\p{Z}\x{0085}]+|[\s\p{Z}\x{0085}]+\z"
BOM = "﻿"


def tidy(x: Column) -> Column:
    return F.regexp_replace(x, EDGE, "")


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def decoded(content: Column) -> Column:
    """UTF-8 text of a binary column; what is not valid becomes U+FFFD."""
    return content.cast("string")


def java_regex(pattern: str) -> str:
    """A search pattern whose $ means the very end, as in linear-time engines; in multi-line patterns it is left alone."""
    flags = pattern[2 : pattern.index(")")] if pattern.startswith("(?") and ":" not in pattern[: pattern.index(")")] else ""
    if "m" in flags:
        return "(?d)" + pattern
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "(?d)" + "".join(out)


def pep508(spec: Column) -> tuple[Column, Column]:
    """Name and the rest (extras, versions, marker) of a requirement; a comment after ' #' counts for neither."""
    body = F.when(F.locate(" #", spec) > 0, tidy(F.substring_index(spec, " #", 1))).otherwise(spec)
    name = F.regexp_extract(body, r"^([A-Za-z0-9._-]*)", 1)
    rest = tidy(F.regexp_replace(body, r"^[A-Za-z0-9._-]*", ""))
    return blank_to_null(name), F.when(name != "", blank_to_null(rest))


def clean_path(path: Column) -> Column:
    """A slash path without '.', empty and resolved '..' steps; a leading '..' stays."""
    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when((s == ".") | (s == ""), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, s: F.when(F.size(done) == 0, F.when(s.isin(".", ""), done).otherwise(F.array(s))).otherwise(step(done, s)))
    return F.array_join(steps, "/")


def parent_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*\z", ""), r"/\z", "")


def quoted(x: Column) -> Column:
    """In double quotes, with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")
