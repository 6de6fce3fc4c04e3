"""Structured documents as tables of nodes.

A small reader per format flattens a document into rows (place, kind, text, size); what is asked of documents (presence,
paths, lockfiles) is then filters, joins and groups over one table, whatever the format.
"""

from __future__ import annotations

import json
import re
import tomllib
from xml.parsers import expat

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from ..functions.paths import I, K

#: Levels of a YAML document at most, as in its usual libraries; nodes per Arrow batch that a task hands on.
MOST_DEEP = 10_000
#: Bytes of an XML document that are parsed at a time.
PIECE = 65_536
BATCH_NODES = 20_000
NODES = "root string, path string, ordinal int, parser string, at string, kind string, value string, size int"
#: A node: place, kind (object, array, string, int, float, bool, null, other, error), text, number of children.
Node = tuple[str, str, str | None, int]
#: What of a document is asked for: steps from the top at most, and keys of the top (of XML: places; None: all). None is everything.
Reach = tuple[int, frozenset[str] | None] | None


def _refuse(constant: str):
    raise ValueError(f"invalid literal {constant}")


def _plain(value, at: str, shown, reach: Reach = None) -> list[Node]:
    """Nodes of JSON-like values within reach; shown gives the text of a value."""
    out: list[Node] = []
    todo = [(value, at, 0)]
    deepest, tops = reach or (1 << 30, None)
    while todo:
        v, at, depth = todo.pop()
        kind = {dict: "object", list: "array", str: "string", bool: "bool", int: "int", float: "float", type(None): "null"}.get(type(v), "other")
        out.append((at, kind, shown(v), len(v) if kind in ("object", "array", "string") else 0))
        if depth == deepest:
            continue
        if kind == "object":
            todo += [(x, f"{at}{K}{k}", depth + 1) for k, x in v.items() if depth or tops is None or k in tops]
        elif kind == "array" and (depth or tops is None):
            todo += [(x, f"{at}{I}{i:08d}", depth + 1) for i, x in enumerate(v)]
    return out


def read_json(content: bytes, reach: Reach = None) -> list[Node]:
    return _plain(json.loads(content.decode("utf-8", "replace"), parse_constant=_refuse), "", lambda v: v if isinstance(v, str) else json.dumps(v) if not isinstance(v, (dict, list)) else None, reach)


def toml_text(v) -> str | None:
    """A TOML value written on one line, keys sorted; None for dates and what holds one."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + "".join({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"}.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 128 else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}") for c in v) + '"'
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return {"inf": "+Inf", "-inf": "-Inf", "nan": "NaN"}.get(str(v)) or (str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v))
    if isinstance(v, list):
        parts = [toml_text(x) for x in v]
        return None if None in parts else "[" + ", ".join(parts) + "]"
    if isinstance(v, dict):
        parts = [(k, toml_text(v[k])) for k in sorted(v)]
        return None if any(x is None for _, x in parts) else "{ " + ", ".join(f"{k} = {x}" for k, x in parts) + " }"
    return None


def read_toml(content: bytes, tables: bool = True, reach: Reach = None) -> list[Node]:
    """tables: whether tables and arrays get their one-line text, which only path queries need."""
    value = tomllib.loads(content.decode("utf-8"))
    return _plain(value, "", lambda v: v if isinstance(v, str) else toml_text(v) if tables or not isinstance(v, (dict, list)) else None, reach)


_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_KINDS = {"str": "string", "int": "int", "float": "float", "bool": "bool", "null": "null"}


def yaml_depth(content: bytes) -> int:
    """How deep the collections of a YAML text nest, from its events, which need no stack."""
    deep = deepest = 0
    for event in yaml.parse(content, Loader=_Loader):
        deep += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
        deepest = max(deepest, deep)
    return deepest


def read_yaml(content: bytes, reach: Reach = None) -> list[Node]:
    """Nodes of the first document; scalars keep the text they are written with. Maps with keys that are not strings have no children here.
    Collections that nest deeper than MOST_DEEP are an error: the library that composes them would end the worker."""
    # brackets open a level each, blocks at most two a column; only a text that could nest too deeply is measured
    flow = content.count(b"[") + content.count(b"{")
    if flow + 2 * max(map(len, re.findall(rb"(?m)^[ \-?:\t]+", content)), default=0) > MOST_DEEP and yaml_depth(content) > MOST_DEEP:
        raise ValueError(f"exceeded max depth of {MOST_DEEP}")
    loader = _Loader(content)
    try:
        top = loader.get_node() if loader.check_node() else None
    finally:
        loader.dispose()
    out: list[Node] = []
    todo = [(top, "", ())] if top is not None else []
    deepest, tops = reach or (1 << 30, None)
    while todo:
        node, at, above = todo.pop()
        deep = len(above) >= deepest
        if isinstance(node, yaml.ScalarNode):
            kind = _KINDS.get(node.tag.rpartition(":")[2], "other")
            out.append((at, kind, node.value, len(node.value)))
        elif id(node) in above:
            raise ValueError("an alias contains itself")
        elif isinstance(node, yaml.SequenceNode):
            out.append((at, "array", None, len(node.value)))
            todo += [(x, f"{at}{I}{i:08d}", (*above, id(node))) for i, x in enumerate(node.value) if not deep and (above or tops is None)]
        else:
            out.append((at, "object", None, len(node.value)))
            pairs: dict = {}
            for k, v in node.value:
                if k.tag.endswith(":merge"):
                    for m in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                        for mk, mv in m.value:
                            pairs.setdefault(mk.value, (mk, mv))
            pairs |= {k.value if isinstance(k, yaml.ScalarNode) else id(k): (k, v) for k, v in node.value if not k.tag.endswith(":merge")}
            if all(k.tag.endswith(":str") for k, _ in pairs.values()):
                todo += [(v, f"{at}{K}{name}", (*above, id(node))) for name, (_, v) in pairs.items() if not deep and (above or tops is None or name in tops)]
    return out


class _Found(Exception):
    """The first place that is asked for."""


def read_xml(content: bytes, reach: Reach = None) -> list[Node]:
    """Distinct element places by local names, from the root; what follows a syntax error is not seen, and the error comes last. With a
    reach, whose second half is the places asked for, the document is read in pieces up to the first of them, and no other gives a row."""
    deepest, wanted = reach or (1 << 30, None)
    out: dict[str, Node] = {}
    stack, deep = [""], 0

    def start(name, _):
        nonlocal deep
        deep += 1
        if deep > deepest:
            return
        stack.append(f"{stack[-1]}{K}{name.rpartition(' ')[2]}")
        if wanted is None or stack[-1] in wanted:
            out.setdefault(stack[-1], (stack[-1], "element", None, 0))
            if wanted is not None:
                raise _Found

    def end(_):
        nonlocal deep
        if deep <= deepest:
            stack.pop()
        deep -= 1

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    if not content.strip():
        return []
    try:
        for at in range(0, len(content), PIECE):
            parser.Parse(content[at : at + PIECE], at + PIECE >= len(content))
    except expat.ExpatError as e:
        return [*out.values(), ("", "error", str(e), 0)]
    except _Found:
        pass
    return list(out.values())


def read_ini(content: bytes) -> list[Node]:
    """Keys as 'key' nodes at section and key, both in lower case; indented lines under a key as its items."""
    out: list[Node] = []
    section, at, many = "default", None, 0
    for line in content.decode("utf-8", "replace").removeprefix("﻿").split("\n"):
        text = line.strip()
        if at and line[:1] in " \t" and text:
            out.append((f"{at}{I}{many:08d}", "string", text, len(text)))
            many += 1
        elif not text or text[0] in "#;":
            continue
        elif text[0] == "[":
            if "]" not in text:
                raise ValueError(f"unclosed section: {text}")
            section, at = text[1 : text.rindex("]")].strip().lower(), None
        else:
            cut = min((i for i in (text.find("="), text.find(":")) if i >= 0), default=-1)
            if cut < 0:
                raise ValueError(f"key-value delimiter not found: {text}")
            at, many = f"{K}{section}{K}{text[:cut].strip().lower()}", 0
            out.append((at, "key", text[cut + 1 :].strip(), 0))
    return out


READERS = {"json": read_json, "yaml": read_yaml, "toml": read_toml, "xml": read_xml, "ini": read_ini}


def nodes(rows: DataFrame, reaches: dict[int, Reach] | None = None) -> DataFrame:
    """NODES of the rows of candidates() that have a format; each document has a row for its top, with the place ''; one that cannot be read gives a row
    of kind error. reaches: by ordinal, what a rule can ask for; the rest of its documents is read and checked, but gives no rows."""
    reaches = reaches or {}

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for root, path, ordinal, parser, form, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reach = reaches.get(ordinal)
                try:
                    if form == "toml":
                        found = read_toml(content or b"", parser == "toml", reach)
                    else:
                        found = READERS[form](content or b"", *([reach] if form in ("json", "yaml", "xml") else []))
                except (ValueError, yaml.YAMLError, RecursionError) as e:
                    found = [("", "error", f"parse {form} file {path!r}: {e}", 0)]
                found = found if any(x[0] == "" for x in found) else [("", "null", None, 0), *found]
                for column, values in zip(out, ([root] * len(found), [path] * len(found), [ordinal] * len(found), [parser] * len(found), *zip(*found, strict=True)), strict=True):
                    column.extend(values)
                if len(out[0]) >= BATCH_NODES:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield _batch(out)

    return rows.where("format is not null").select("root", "path", "ordinal", "parser", "format", "content").mapInArrow(run, NODES)


def _batch(columns: list[list]) -> pa.RecordBatch:
    names = [f.split()[0] for f in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("ordinal", "size") else pa.string()) for n, c in zip(names, columns, strict=True)], names)
