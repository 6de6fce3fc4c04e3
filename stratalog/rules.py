"""Rule files: an ordered list of selectors, each with at most one reader."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .functions.paths import glob_problem, glob_regex, path_steps
from .functions.text import java_regex

#: Letters of a name's beginning by which rules are found.
PREFIX = 4
#: Readers without options.
PLAIN = ("py-requirements", "pipfile-lock", "poetry-lock", "uv-lock", "go-mod", "package-lock", "pnpm-lock", "composer-lock", "cargo-lock", "yarn-lock")
#: Format in which a reader's documents are parsed to nodes.
FORMATS = {
    "json": "json", "yaml": "yaml", "toml": "toml", "xml": "xml", "ini": "ini", "pipfile-lock": "json", "composer-lock": "json", "package-lock": "json",
    "poetry-lock": "toml", "uv-lock": "toml", "cargo-lock": "toml", "pnpm-lock": "yaml", "yarn-lock": "yaml",
}
OPTIONED = ("banner-regex", "terraform", "ini", "typescript", "python", "yaml", "toml", "json", "xml", "html")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    ordinal: int
    type: str
    filename_regex: str | None
    path_glob: str | None
    parser: str | None = None
    params: dict = field(default_factory=dict)

    @property
    def exact_name(self) -> str | None:
        """The one name that the selector accepts, if it is so simple."""
        if self.path_glob or not self.filename_regex:
            return None
        m = re.fullmatch(r"\^((?:[A-Za-z0-9_-]|\\\.)+)\$", self.filename_regex)
        return m[1].replace("\\.", ".") if m else None

    @property
    def index_key(self) -> str | None:
        """What an accepted file's name must have: n:<the name>, e:<its last extension> or p:<its first PREFIX letters>; None if that cannot be told."""
        pattern = self.filename_regex or ""
        if self.exact_name:
            return f"n:{self.exact_name}"
        if pattern and not pattern.startswith("(?") and "|" not in pattern:
            tail = re.search(r"(?:^\^|[^\\])((?:\\\.|[A-Za-z0-9_-])+)\$$", pattern)
            text = tail[1].replace("\\.", ".") if tail else ""
            if "." in text:
                return f"e:{text[text.rindex('.'):]}"
            head = re.match(r"\^((?:\\\.|[A-Za-z0-9_-])+)(?![?*+{])", pattern)
            text = head[1].replace("\\.", ".") if head else ""
            if len(text) >= PREFIX:
                return f"p:{text[:PREFIX]}"
        last = (self.path_glob or "").rpartition("/")[2]
        if last and not re.search(r"[*?\[\\]", last):
            return f"n:{last}"
        tail = re.fullmatch(r"\*+[A-Za-z0-9_-]*((?:\.[A-Za-z0-9_-]+)+)", last)
        return f"e:{tail[1][tail[1].rindex('.'):]}" if tail and not last.startswith("**") else None

    @property
    def keyed_only(self) -> bool:
        """Whether a name with the index key is accepted, without a look at the pattern."""
        return bool(self.exact_name or re.fullmatch(r"\^?\.\*\\\.[A-Za-z0-9_-]+\$", self.filename_regex or ""))

    @property
    def name_regex(self) -> str | None:
        return java_regex(self.filename_regex) if self.filename_regex else None

    @property
    def path_regex(self) -> str | None:
        return glob_regex(self.path_glob) if self.path_glob else None


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...]

    @property
    def types(self) -> list[str]:
        """Distinct types by first rule."""
        return list(dict.fromkeys(r.type for r in self.rules))

    def only(self, *types: str) -> Ruleset:
        """The rules of these types, with their ordinals."""
        return Ruleset(tuple(r for r in self.rules if r.type in types))

    def using(self, *parsers: str) -> list[Rule]:
        return [r for r in self.rules if r.parser in parsers]


def _need(ok, field_: str, what: str) -> None:
    if not ok:
        raise RuleError(f"{field_}: {what}")


def _strings(value, field_: str) -> list[str]:
    _need(isinstance(value, list) and value and all(isinstance(x, str) for x in value), field_, "must be a list of strings with at least one entry")
    return value


def _conditions(items, field_: str, name: str) -> None:
    for i, c in enumerate(items or []):
        at = f"{field_}[{i}]"
        _need(c.get(name), f"{at}.{name}", "required")
        _need(("equals" in c) != bool(c.get("present")), at, "exactly one of equals and present is required")


def _paths(values, field_: str, wildcard: bool = False, lists: bool = True) -> None:
    for i, q in enumerate(values):
        try:
            path_steps(q, wildcard, lists)
        except ValueError as e:
            raise RuleError(f"{field_}[{i}]: {e}") from None


def _check(kind: str, p) -> None:
    """RuleError if a reader's options are not valid."""
    if kind == "banner-regex":
        _need(isinstance(p, str) and p, kind, "required")
        try:
            groups = re.compile(p).groups
        except re.error as e:
            raise RuleError(f"{kind}: compile {p!r}: {e}") from None
        _need(groups >= 2, kind, "must have at least two groups")
        return
    if kind in PLAIN:
        return
    _need(isinstance(p, dict), kind, "must be a mapping")
    if kind == "html":
        _need(p.get("external_scripts") is True, "html.external_scripts", "must be true")
    elif kind == "json":
        _need(all(_strings(p.get("exists-any"), "json.exists-any")), "json.exists-any", "empty key")
    elif kind == "xml":
        _paths(_strings(p.get("exists-any"), "xml.exists-any"), "xml.exists-any", lists=False)
    elif kind == "yaml":
        given = [k for k in ("query", "exists", "exists-any") if p.get(k)]
        _need(len(given) == 1, "yaml", "exactly one of query, exists and exists-any is required")
        _paths([p[given[0]]] if given[0] != "exists-any" else _strings(p["exists-any"], "yaml.exists-any"), f"yaml.{given[0]}")
    elif kind == "toml":
        given = [k for k in ("queries", "table-queries", "exists-any", "table-exists-any") if p.get(k)]
        _need(given, "toml", "at least one of queries, table-queries, exists-any and table-exists-any is required")
        for k in given:
            _paths(_strings(p[k], f"toml.{k}"), f"toml.{k}", wildcard=True)
    elif kind == "ini":
        _need(isinstance(p.get("queries"), list) and p["queries"], "ini.queries", "required")
        for i, q in enumerate(p["queries"]):
            for k in ("section", "key"):
                _need(q.get(k), f"ini.queries[{i}].{k}", "required")
            _need("*" not in q["key"] or q["key"] == "*", f"ini.queries[{i}].key", "* must stand alone")
    elif kind == "terraform":
        _need(p.get("resource_type"), "terraform.resource_type", "required")
        _need(p.get("conditions"), "terraform.conditions", "required")
        _conditions(p["conditions"], "terraform.conditions", "path")
    elif kind in ("typescript", "python"):
        given = [k for k in ("cdk_construct", "call") if p.get(k) and (k == "cdk_construct" or kind == "python")]
        _need(len(given) == 1, kind, "exactly one matcher is required")
        c, at = p[given[0]], f"{kind}.{given[0]}"
        if given[0] == "cdk_construct":
            for k in ("module", "construct", *(["keyword_argument"] if kind == "python" else [])):
                _need(c.get(k), f"{at}.{k}", "required")
            if kind == "typescript":
                _need(isinstance(c.get("props_argument_index", 0), int) and c.get("props_argument_index", 0) >= 0, f"{at}.props_argument_index", "must not be negative")
            _need(c.get("conditions"), f"{at}.conditions", "required")
            _conditions(c["conditions"], f"{at}.conditions", "key")
            if c.get("extract") is not None:
                _need(c["extract"].get("key"), f"{at}.extract.key", "required")
                _need(c["extract"].get("split") == "comma", f"{at}.extract.split", "must be comma")
        else:
            for k in ("module", "function"):
                _need(c.get(k), f"{at}.{k}", "required")
            conditions = c.get("conditions") or {}
            _need(conditions.get("all_of") or conditions.get("any_of"), f"{at}.conditions", "required")
            for k in ("all_of", "any_of"):
                _conditions(conditions.get(k), f"{at}.conditions.{k}", "keyword")
            for i, x in enumerate(c.get("extract") or []):
                _need(x.get("keyword"), f"{at}.extract[{i}].keyword", "required")
                _need(x.get("literal") in ("string_list", "dict_string_lists"), f"{at}.extract[{i}].literal", "unknown literal")


def parse_rules(text: str, source: str = "rules") -> Ruleset:
    """The ruleset in YAML text; RuleError names the source and the field at fault. Unknown keys are ignored; a block without a
    value, as `uv-lock:`, counts as absent."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"parse rules from {source}: {e}") from None
    items = raw.get("rules") if isinstance(raw, dict) else None
    if not items:
        raise RuleError(f"{source}: rules: must contain at least one rule")
    rules = []
    for i, r in enumerate(items):
        at = f"{source}: rules[{i}]"
        name, pattern, glob = r.get("name"), r.get("filename-regex"), r.get("path-glob")
        if not name:
            raise RuleError(f"{at}.name: required")
        if not pattern and not glob:
            raise RuleError(f"{at}: at least one selector is required")
        if pattern:
            try:
                re.compile(pattern)
            except re.error as e:
                raise RuleError(f"{at}.filename-regex: compile {pattern!r}: {e}") from None
        if glob and (problem := glob_problem(glob)):
            raise RuleError(f"{at}.path-glob: compile {glob!r}: {problem}")
        readers = [k for k in (*PLAIN, *OPTIONED) if r.get(k) is not None and r.get(k) != ""]
        if len(readers) > 1:
            raise RuleError(f"{at}: at most one parser is allowed")
        params = r[readers[0]] if readers else {}
        if readers:
            try:
                _check(readers[0], params)
            except RuleError as e:
                raise RuleError(f"{at}: {e}") from None
        rules.append(Rule(i, name, pattern or None, glob or None, readers[0] if readers else None, {"pattern": params} if isinstance(params, str) else dict(params)))
    return Ruleset(tuple(rules))


def load_rules(path: str) -> Ruleset:
    return parse_rules(Path(path).read_text(), path)


def builtin_rules() -> Ruleset:
    return parse_rules((Path(__file__).parent / "builtin_rules.yaml").read_text(), "built-in rules")
