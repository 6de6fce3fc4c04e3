"""Readers of Terraform, TypeScript and Python sources: literal arguments of known constructs.

Files whose text cannot hold what is asked for are set aside in the JVM; the rest go to the literal reader, one file at a
time in Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hcl
from ..functions.literals import CLOSING, OTHER, Name, Source
from ..rules import Ruleset
from ..schema import KEY
from ..storage import kept
from .presence import any_of, dep_rows, found_rows

#: A match: whether, its dependencies, an error.
NO, UNKNOWN = (False, [], None), (True, [], None)


def split_commas(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def _of(s: Source, obj, key: str, at: int):
    """The value of the first key of a Python dict that is, or leads to, a string; None without one."""
    for k, v in obj.items() if isinstance(obj, dict) else ():
        if k == key or isinstance(k, Name) and s.resolved(k, at) == key:
            return v
    return None


def _meets(s: Source, obj: dict, conditions: list[dict], at: int) -> bool:
    for c in conditions:
        value = _of(s, obj, c["key"], at)
        if value is None or not c.get("present") and s.resolved(value, at) != c["equals"]:
            return False
    return True


def python_names(text: str, module: str, name: str) -> tuple[set[str], set[str]]:
    """Names by which a source knows a module, and those by which it knows a member. Of an import list the first name is read."""
    spaces, own = set(), set()
    package, _, leaf = module.rpartition(".")
    for line in text.split("\n"):
        if "import" not in line:
            continue
        w = line.split()
        alias = w[-1] if len(w) > 2 and w[-2] == "as" else None
        if w[:1] == ["import"] and len(w) > 1 and w[1] == module:
            spaces.add(alias or module)
        elif w[:1] == ["from"] and len(w) > 3 and w[2] == "import":
            if w[1] == package and w[3] == leaf:
                spaces.add(alias or leaf)
            elif w[1] == module and w[3] == name:
                own.add(alias or name)
    return spaces, own


def _calls(s: Source, spaces: set[str], own: set[str], name: str):
    """(place of the call, of its opening bracket, of its closing one)."""
    for i, (kind, t, _) in enumerate(s.tokens):
        if kind != "name" or t != name and t not in own or s.text(i + 1) != "(":
            continue
        prefix, j = "", i
        while s.text(j - 1) == "." and s.kind(j - 2) == "name":
            j -= 2
            prefix = s.text(j) + ("." + prefix if prefix else "")
        if (not prefix and s.text(i) in own or s.text(i) == name and prefix in spaces) and (end := s.close(i + 1)) is not None:
            yield j, i + 1, end


def match_python(text: str, p: dict) -> tuple[bool, list[str], str | None]:
    call, cdk = p.get("call"), p.get("cdk_construct")
    c = call or cdk
    name = c.get("function") or c.get("construct")
    spaces, own = python_names(text, c["module"], name)
    if not spaces and not own:
        return NO
    s = Source(text, "python")
    for at, begin, end in _calls(s, spaces, own, name):
        args = {s.text(a): s.value(a + 2, b) for a, b in s.split(begin + 1, end) if s.kind(a) == "name" and s.text(a + 1) == "="}
        if call:
            ok = lambda x, args=args, at=at: x["keyword"] in args and (bool(x.get("present")) or s.resolved(args[x["keyword"]], at) == x.get("equals"))
            conditions = call["conditions"]
            if not all(map(ok, conditions.get("all_of") or [])) or conditions.get("any_of") and not any(map(ok, conditions["any_of"])):
                continue
            found: list[str] = []
            for x in call.get("extract") or []:
                v = args.get(x["keyword"])
                lists = [v] if x["literal"] == "string_list" else list(v.values()) if isinstance(v, dict) and all(isinstance(k, str) for k in v) else []
                if all(isinstance(y, list) and all(isinstance(z, str) for z in y) for y in lists):
                    found += [z for y in lists for z in y]
            return True, list(dict.fromkeys(found)), None
        obj = s.resolved(args.get(cdk["keyword_argument"], OTHER), at)
        for step in cdk.get("within") or []:
            inner = _of(s, obj, step, end)
            obj = OTHER if inner is None else s.resolved(inner, end)
        if not isinstance(obj, dict) or not _meets(s, obj, cdk["conditions"], end):
            continue
        if not cdk.get("extract"):
            return UNKNOWN
        value = _of(s, obj, cdk["extract"]["key"], end)
        value = OTHER if value is None else s.resolved(value, end)
        if isinstance(value, str) and (deps := split_commas(value)):
            return True, deps, None
    return NO


def typescript_names(s: Source, module: str, name: str) -> tuple[set[str], set[str]]:
    spaces, own = set(), set()
    for i in range(len(s.tokens)):
        if s.text(i) != "import" or s.kind(i) != "name":
            continue
        end = i + 1
        while end < len(s.tokens) and s.kind(end) not in ("string", "text") and s.text(end) not in (";", "=", "(") and not (s.text(end) == "from" and s.kind(end + 1) == "string"):
            end = (s.close(end) or len(s.tokens)) + 1 if s.text(end) == "{" else end + 1
        if s.text(end) != "from" or s.kind(end + 1) != "string" or s.string(end + 1) != module:
            continue
        if [s.text(i + 1), s.text(i + 2)] == ["*", "as"]:
            spaces.add(s.text(i + 3))
        start = next((j for j in range(i, end) if s.text(j) == "{"), None)
        if start is not None:
            for a, b in s.split(start + 1, s.close(start) or end):
                if s.text(a) == name:
                    own.add(s.text(a + 2) if s.text(a + 1) == "as" else s.text(a))
            del b
    return spaces, own


def _news(s: Source, spaces: set[str], own: set[str], name: str):
    """(place of new, of its opening bracket, of its closing one) of the new expressions of a construct: a name, or a namespace's member."""
    for i in range(len(s.tokens)):
        if s.text(i) != "new" or s.kind(i) != "name" or s.text(i - 1) == "." or s.kind(i + 1) != "name":
            continue
        if s.text(i + 2) == ".":
            known, at = s.text(i + 1) in spaces and s.text(i + 3) == name, i + 4
        else:
            known, at = s.text(i + 1) in own, i + 2
        if not known:
            continue
        deep = 0
        while s.text(at) in ("<", ">") or deep and s.text(at):  # type arguments
            deep += {"<": 1, ">": -1}.get(s.text(at), 0)
            at += 1
        if s.text(at) == "(" and (end := s.close(at)) is not None:
            yield i, at, end


def match_typescript(text: str, p: dict) -> tuple[bool, list[str], str | None]:
    """The last new expression that fits counts, those within one that fits left out. Kinds of expressions decide, as in a syntax tree: the properties are an object
    or the name of one, strings are strings or names of one, and an object in brackets, with `as` or with `satisfies` is none."""
    c = p["cdk_construct"]
    s = Source(text, "typescript")
    spaces, own = typescript_names(s, c["module"], c["construct"])
    out, after = NO, 0
    for at, begin, end in _news(s, spaces, own, c["construct"]) if spaces or own else ():
        args, index = s.split(begin + 1, end), c.get("props_argument_index", 0)
        if at < after or len(args) <= index or not (place := s.found(*args[index], "object")):
            continue
        for step in c.get("within") or []:
            place = place and s.member(*place, step)
            place = place if place and s.expression(*place) == "object" else None
        if not place or not all(_holds(s, place, x) for x in c["conditions"]):
            continue
        value = s.member(*place, c["extract"]["key"]) if c.get("extract") else None
        if c.get("extract") and not value:
            continue
        out, after = (True, split_commas((value and s.string_of(*value)) or ""), None), end
    return out


def _holds(s: Source, place: tuple[int, int], condition: dict) -> bool:
    value = s.member(*place, condition["key"])
    return bool(value) and (bool(condition.get("present")) or s.string_of(*value) == condition["equals"])


def match_terraform(text: str, p: dict) -> tuple[bool, list[str], str | None]:
    s = Source(text, "hcl")
    i, n = 0, len(s.tokens)
    matched = False
    while i < n:
        if s.text(i) == "\n":
            i += 1
            continue
        labels = i
        while s.kind(i) in ("name", "string"):
            i += 1
        if s.text(i) == "=" and i == labels + 1:
            while i < n and s.text(i) != "\n":
                i = (s.close(i) if s.text(i) in CLOSING and s.text(i) else i) or n
                i += 1
            continue
        if s.text(i) != "{" or i == labels or (end := s.close(i)) is None:
            return False, [], "invalid block"
        head = [s.string(j) if s.kind(j) == "string" else s.text(j) for j in range(labels, i)]
        if head[:2] == ["resource", p["resource_type"]] and not matched:
            body = {s.text(a): s.tokens[a + 2 : b] for a, b in s.split(i + 1, end) if s.kind(a) == "name" and s.text(a + 1) == "="}
            matched = all(_condition(body, c) for c in p["conditions"])
        i = end + 1
    return matched, [], None


def _condition(body: dict, c: dict) -> bool:
    """Whether an attribute's constant value holds what is asked for; one that needs a variable or a function holds nothing."""
    name, *rest = c["path"].split(".")
    try:
        value = hcl.constant(body[name])
    except (KeyError, hcl.Unknown):
        return False
    for k in rest:
        if not isinstance(value, dict) or k not in value:
            return False
        value = value[k]
    return value is not None if c.get("present") else isinstance(value, str) and value == c["equals"]


MATCHERS = {"python": match_python, "typescript": match_typescript, "terraform": match_terraform}


def _needed(rule) -> F.Column:
    """A text that a match cannot do without."""
    p = rule.params
    c = p.get("cdk_construct") or p.get("call")
    return F.col("content").cast("string").contains(p["resource_type"] if rule.parser == "terraform" else c.get("construct") or c.get("function"))


def literal_sources(rows: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    """FOUND and DEPS of the readers in MATCHERS. Terraform is read in whole, as a syntax error there is an error of the file."""
    wanted = rules.using(*MATCHERS)
    params = {r.ordinal: (r.parser, r.params) for r in wanted}
    own = rows.where(any_of([(F.col("ordinal") == r.ordinal) & (F.lit(True) if r.parser == "terraform" else _needed(r)) for r in wanted]))

    def run(batches):
        for batch in batches:
            out = []
            for root, path, ordinal, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser, p = params[ordinal]
                try:
                    got = MATCHERS[parser]((content or b"").decode("utf-8", "replace"), p)
                except RecursionError as e:  # a file never ends the job
                    got = (False, [], f"parse {parser} file {path!r}: {e}")
                out.append((root, path, ordinal, *got))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*KEY, "matched", "deps", "error"])

    # both results come of one reading
    got = kept(own.select(*KEY, "content").mapInArrow(run, "root string, path string, ordinal int, matched boolean, deps array<string>, error string"))
    deps = got.select(*KEY, F.posexplode("deps").alias("i", "raw"))
    return found_rows(got, F.col("matched"), F.lit(None), F.col("error")), dep_rows(deps, F.format_string("%07d", "i"), raw=F.col("raw"))
