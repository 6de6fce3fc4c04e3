"""Presence checks and path queries over document nodes."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import I, K, key, path_regex, path_steps
from ..functions.text import pep508, tidy
from ..rules import Ruleset
from ..schema import KEY

DEP = ("raw", "name", "version", "constraint", "section", "source", "extras")


def dep_rows(rows: DataFrame, seat: Column, **fields: Column) -> DataFrame:
    """DEPS from columns; fields not given are null."""
    kinds = {"extras": "map<string,string>"}
    return rows.select(*KEY, seat.cast("string").alias("seat"), *[fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in DEP])


def found_rows(rows: DataFrame, matched: Column, absent: Column | None = None, error: Column | None = None) -> DataFrame:
    return rows.select(*KEY, matched.cast("boolean").alias("matched"), (F.lit(False) if absent is None else absent).cast("boolean").alias("absent"), (F.lit(None) if error is None else error).cast("string").alias("error"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def hits(rules: Ruleset, parser: str, option: str, wildcard: bool = False) -> Column:
    """Whether a node's place answers one of the paths of its rule's option."""
    at, each = F.col("at"), []
    for r in rules.using(parser):
        paths = r.params.get(option) or []
        for p in [paths] if isinstance(paths, str) else paths:
            each.append((F.col("ordinal") == r.ordinal) & at.rlike(path_regex(p, wildcard)))
    return any_of(each)


def having(rules: Ruleset, parser: str, *options: str) -> Column:
    return F.col("ordinal").isin([r.ordinal for r in rules.using(parser) if any(r.params.get(o) for o in options)] or [-1])


def _place(steps: list[tuple[str, bool]]) -> str:
    return "".join(K + name for name, _ in steps)


def reaches(rules: Ruleset) -> dict[int, tuple[int, frozenset[str] | None]]:
    """What the rules that only ask for places can reach in their documents, by ordinal: steps from the top, keys of the top (of XML: places)."""
    out = {}
    for r in rules.using("json", "yaml", "toml", "xml"):
        if r.parser == "json":
            out[r.ordinal] = (1, frozenset(r.params["exists-any"]))
            continue
        if r.parser == "xml":
            steps = [path_steps(p, lists=False) for p in r.params["exists-any"]]
            out[r.ordinal] = (max(map(len, steps)), frozenset(map(_place, steps)))
            continue
        given = [x for o in ("query", "exists", "exists-any", "queries", "table-queries", "table-exists-any") for x in ([r.params[o]] if isinstance(r.params.get(o), str) else r.params.get(o) or [])]
        steps = [path_steps(q, True) for q in given]
        # tables that a query names give a row per key
        deepest = max(sum(1 + each for _, each in x) for x in steps) + 1
        out[r.ordinal] = (deepest, None if any(x[0][0] == "*" for x in steps) else frozenset(x[0][0] for x in steps))
    return out


#: Rows that tell of every document whether it could be read.
EACH = "at = '' or kind = 'error'"
#: Not empty: everything but null, "", [] and {}.
FULL = "kind <> 'null' and not (kind in ('string', 'array', 'object') and size = 0) and kind <> 'error'"


def presence(nodes: DataFrame, rules: Ruleset) -> DataFrame:
    """FOUND of the readers that only say whether dependencies are there."""
    top_keys = any_of([(F.col("ordinal") == r.ordinal) & F.col("at").isin([K + k for k in r.params["exists-any"]]) for r in rules.using("json")])
    # true and any number count in JSON, false does not
    full_json = top_keys & F.expr(f"({FULL}) and not (kind = 'bool' and value = 'false')")
    xml = any_of([(F.col("ordinal") == r.ordinal) & F.col("at").isin([_place(path_steps(p, lists=False)) for p in r.params["exists-any"]]) for r in rules.using("xml")])
    toml = having(rules, "toml", "exists-any", "table-exists-any")
    full = F.when(F.col("parser") == "json", full_json).when(F.col("parser") == "xml", xml)
    full = full.when(F.col("parser") == "yaml", hits(rules, "yaml", "exists-any") & F.expr(FULL))
    # where exists-any is given, table-exists-any is not asked
    full = full.when(having(rules, "toml", "exists-any"), hits(rules, "toml", "exists-any", True) & F.expr(FULL)).otherwise(hits(rules, "toml", "table-exists-any", True) & F.expr("kind = 'object' and size > 0"))
    asked = (F.col("parser").isin("json", "xml")) | having(rules, "yaml", "exists-any") | toml
    error = F.max(F.when(F.col("kind") == "error", F.col("value")))
    root_kind = F.max(F.when((F.col("at") == "") & (F.col("kind") != "error"), F.col("kind")))
    yes = nodes.where(asked & (full | F.expr(EACH))).groupBy(*KEY, "parser").agg(F.max(full).alias("has"), error.alias("error"), root_kind.alias("root_kind"))
    odd = (F.col("parser") == "json") & ~F.coalesce(F.col("root_kind").isin("object", "null"), F.lit(True))
    # what is found before a syntax error counts in XML, which is read as a stream
    bad = F.when((F.col("parser") == "xml") & F.col("has"), F.lit(None)).when(odd, F.lit("the top is not an object")).otherwise(F.col("error"))
    return found_rows(yes, bad.isNull(), F.coalesce("has", F.lit(False)), bad)


def existence(nodes: DataFrame, rules: Ruleset) -> DataFrame:
    """FOUND of yaml.exists: a match of unknown status where the path leads to a node."""
    hit = hits(rules, "yaml", "exists")
    yes = nodes.where(having(rules, "yaml", "exists") & (hit | F.expr(EACH))).groupBy(*KEY).agg(F.max(hit).alias("has"), F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))
    return found_rows(yes, F.col("has"), F.lit(None), F.col("error"))


def _read(nodes: DataFrame, parser: str, condition: Column) -> DataFrame:
    """FOUND of readers that match only with dependencies."""
    files = nodes.where((F.col("parser") == parser) & condition & F.expr(EACH)).groupBy(*KEY).agg(F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))
    return found_rows(files, F.lit(None), F.lit(None), F.col("error"))


def yaml_queries(nodes: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    own = nodes.where(hits(rules, "yaml", "query") & F.expr("kind = 'string' and size > 0"))
    return _read(nodes, "yaml", having(rules, "yaml", "query")), dep_rows(own, F.col("at"), raw=F.col("value"))


def _order(name: Column) -> Column:
    """Keys named packages come first, then dev-packages, then the rest."""
    return F.when(name == "packages", "0").when(name == "dev-packages", "1").otherwise("2")


def _dotted(at: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(at, f"{I}\\d+", ""), f"^{K}", ""), K, ".")


def toml_queries(nodes: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    """Strings and dependency tables that queries and table-queries reach. A table gives a row `key = value` per key."""
    n = nodes.where((F.col("parser") == "toml") & having(rules, "toml", "queries", "table-queries"))
    last = F.substring_index("at", K, -1)
    parts = []
    for r in rules.using("toml"):
        own = n.where(F.col("ordinal") == r.ordinal)
        for i, q in enumerate(r.params.get("queries") or []):
            steps = path_steps(q, True)
            name, rest = pep508(F.col("value"))
            plain = ~F.col("value").contains(" = ")
            leaf = own.where(F.col("at").rlike(path_regex(q, True)) & F.expr("kind = 'string' and size > 0"))
            parts.append(dep_rows(leaf, F.concat(F.lit(f"0{i:04d}"), "at"), raw=F.col("value"), name=F.when(plain, name), constraint=F.when(plain, rest), section=_dotted(F.col("at"))))
            if not steps[-1][1]:
                poetry = [s for s, _ in steps] == ["tool", "poetry", "dependencies"] or len(steps) == 5 and [s for s, _ in steps[:3]] == ["tool", "poetry", "group"] and steps[4][0] == "dependencies"
                inside = own.where(F.col("at").rlike(path_regex(q, True)[: -len(r"\z")] + f"{K}[^{K}{I}]*" + r"\z") & F.col("value").isNotNull() & ((last != "python") if poetry else F.lit(True)))
                parts.append(_entries(inside, f"0{i:04d}", F.lit("")))
        for i, q in enumerate(r.params.get("table-queries") or []):
            inside = own.where(F.col("at").rlike(path_regex(q, True)[: -len(r"\z")] + f"{K}[^{K}{I}]*" + r"\z") & F.col("value").isNotNull())
            table = F.element_at(F.split("at", K), -2)
            inside = inside.where(~table.isin(r.params.get("exclude-keys") or [""]))
            parts.append(_entries(inside, f"1{i:04d}", F.concat(_order(table), table, F.lit(K))))
    deps = reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    exists = having(rules, "toml", "queries", "table-queries") & ~having(rules, "toml", "exists-any", "table-exists-any")
    return _read(nodes, "toml", exists), deps


def _entries(inside: DataFrame, lead: str, group: Column) -> DataFrame:
    name, parent = F.substring_index("at", K, -1), F.regexp_replace("at", f"{K}[^{K}]*$", "")
    shown = F.when(F.col("kind") == "string", _quoted_toml(F.col("value"))).otherwise(F.col("value"))
    return dep_rows(inside, F.concat(F.lit(lead), group, parent, F.lit(K), _order(name), name), raw=F.concat(name, F.lit(" = "), shown), section=_dotted(parent))


def _quoted_toml(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def ini_queries(nodes: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    """Indented lines below the keys asked for; a key on one line gives a match without dependencies."""
    at, wanted, ranked = F.col("at"), [], F.lit(None)
    for r in rules.using("ini"):
        for i, q in enumerate(r.params["queries"]):
            place = key(q["section"].lower()) + (f"{K}[^{K}{I}]*" if q["key"] == "*" else key(q["key"].lower()))
            hit = (F.col("ordinal") == r.ordinal) & at.rlike(f"^{place}({I}|\\z)")
            wanted.append(hit)
            ranked = F.coalesce(ranked, F.when(hit, F.lit(f"{i:04d}")))
    n = nodes.where(F.col("parser") == "ini")
    files = n.groupBy(*KEY).agg(F.max(any_of(wanted)).alias("has"), F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))
    text = tidy(F.regexp_replace("value", r"[ \t][#;].*$", ""))
    deps = n.where(any_of(wanted) & (F.col("kind") == "string")).withColumn("text", text).where(~F.col("value").rlike("^[#;]") & (F.col("text") != "") & ~F.col("text").rlike(r"^(file:|%\()"))
    return found_rows(files, F.col("has"), F.lit(False), F.col("error")), dep_rows(deps, F.concat(ranked, at), raw=F.col("text"))
