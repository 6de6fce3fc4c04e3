"""Which rules each file is a candidate of.

Rules are looked up by literal parts of a file's name, and only those found are tried as patterns. It is one projection: no join,
no shuffle, and content is read of the files alone that a reader's selectors accept.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import FORMATS, PREFIX, Ruleset
from ..sources.contents import opened

#: Banners lie in the first bytes of a file.
BANNER_BYTES = 4096
DEFAULT_IGNORED = (".git", "node_modules", ".venv", "venv", "vendor", ".tox", ".mypy_cache", ".pytest_cache")


def not_ignored(path: Column, ignored=DEFAULT_IGNORED) -> Column:
    """Whether no folder of a path has one of the names."""
    folders = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, ignored))) if ignored else F.lit(True)


def _constant(value, schema: str) -> Column:
    """A nested literal, folded once."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(schema))


def candidate_ordinals(rules: Ruleset, name: Column, path: Column) -> Column:
    """Ordinals of the rules whose selectors accept a file, ascending, up to the first one without a reader.

    Rules are found by the name, the extension and the first letters of a file in one hashed table, and only those found are tried as patterns, so what
    a file costs does not grow with the rules; rules that have none of these are tried on every file."""
    if not rules.rules:
        return F.array().cast("array<int>")
    keyed = [(k, r.ordinal) for r in rules.rules if (k := r.index_key)]
    most = max(r.ordinal for r in rules.rules)
    names: list[str | None] = [None] * (most + 1)
    paths = list(names)
    for r in rules.rules:
        names[r.ordinal], paths[r.ordinal] = None if r.keyed_only else r.name_regex, r.path_regex
    found = []
    for r in rules.rules:
        if not r.index_key:
            hit = name.rlike(r.name_regex) if r.name_regex else F.lit(True)
            found.append(F.when(hit & path.rlike(r.path_regex) if r.path_regex else hit, F.lit(r.ordinal)))
    tried = F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")
    if keyed:
        size = 1 << (2 * len(keyed)).bit_length()
        buckets: list[list] = [[] for _ in range(size)]
        for k, o in keyed:
            buckets[zlib.crc32(k.encode()) % size].append({"k": k, "o": o})
        table = _constant(buckets, "array<array<struct<k:string,o:int>>>")
        keys = F.array(F.concat(F.lit("n:"), name), F.concat(F.lit("e:."), F.substring_index(name, ".", -1)), F.concat(F.lit("p:"), F.substring(name, 1, PREFIX)))
        own = lambda k: F.filter(F.get(table, (F.crc32(k.cast("binary")) % size).cast("int")), lambda e: e["k"] == k)
        near = F.flatten(F.transform(keys, lambda k: F.transform(own(k), lambda e: e["o"])))
        patterns, globs = _constant(names, "array<string>"), _constant(paths, "array<string>")
        fits = lambda text, given, o: F.coalesce(F.rlike(text, F.get(given, o)), F.lit(True))
        tried = F.concat(tried, F.filter(near, lambda o: fits(name, patterns, o) & fits(path, globs, o)))
    final = [r.parser is None for r in rules.rules]
    if not any(final):
        return F.sort_array(tried)
    ends = _constant([o in {r.ordinal for r in rules.rules if r.parser is None} for o in range(most + 1)], "array<boolean>")
    # arrays of one bind what is found, and the first rule without a reader, so that each is worked out once
    once = lambda x, f: F.transform(F.array(x), f)[0]
    up_to = lambda a: once(F.array_min(F.filter(a, lambda o: F.get(ends, o))), lambda stop: F.filter(a, lambda o: stop.isNull() | (o <= stop)))
    return once(F.sort_array(tried), up_to)


def selector_type(rules: Ruleset, name: Column) -> Column:
    """The type of the first rule without a path glob and without a reader that accepts a file name; null where none does."""
    plain = [r for r in rules.rules if r.parser is None and not r.path_glob]
    return F.coalesce(*[F.when(name.rlike(r.name_regex), F.lit(r.type)) for r in plain], F.lit(None).cast("string"))


def candidates(files: DataFrame, rules: Ruleset, globs: bool = True) -> DataFrame:
    """(root, path, name, content, rank, ordinal, parser, format, unread): one row per file and candidate rule, rank counting a file's from 0. Where files have no content, those that a
    reader accepts by name and path are opened, once each, and unread says why one could not be. Without globs, rules with a
    path glob accept nothing; the path '' is that of no file, which only rules without a reader accept."""
    if not globs:
        rules = Ruleset(tuple(r for r in rules.rules if not r.path_glob))
    if not rules.rules:
        return files.select("root", "path", F.col("path").alias("name"), F.lit(None).cast("binary").alias("content"), F.lit(0).alias("rank"), F.lit(0).alias("ordinal"), F.lit("").alias("parser"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("unread")).where(F.lit(False))
    parser = F.create_map(*[x for r in rules.rules for x in (F.lit(r.ordinal), F.lit(r.parser or ""))])
    formats = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))])
    path = F.regexp_replace("path", r"\\", "/")
    name = F.coalesce(F.col("name"), F.substring_index(path, "/", -1))
    lazy = "content" not in files.columns
    chosen = files.select("root", "path", name.alias("name"), *([] if lazy else ["content"])).withColumn("ordinals", candidate_ordinals(rules, F.col("name"), path))
    if lazy:
        read = F.transform("ordinals", lambda o: parser[o])
        most = F.when(F.forall(read, lambda p: p == "") | (F.col("path") == ""), F.lit(0)).when(F.forall(read, lambda p: p.isin("", "banner-regex")), F.lit(BANNER_BYTES))
        chosen = opened(chosen.where(F.size("ordinals") > 0), most)
    else:
        chosen = chosen.withColumn("unread", F.lit(None).cast("string"))
    found = chosen.select(*[path.alias("path") if c == "path" else c for c in chosen.columns if c != "ordinals"], F.posexplode_outer("ordinals").alias("rank", "ordinal"))
    # outer, and what has none dropped after: else Spark filters the files by their candidates first, and works these out twice
    found = found.where("ordinal is not null")
    named = found.withColumn("parser", parser[F.col("ordinal")]).withColumn("format", formats[F.col("parser")])
    named = named.where("path <> '' or parser = ''")
    # selectors need no content
    content = F.when(F.col("parser") == "banner-regex", F.substring("content", 1, BANNER_BYTES)).when(F.col("parser") != "", F.col("content"))
    return named.withColumn("content", content).withColumn("unread", F.when(F.col("parser") != "", F.col("unread")))
