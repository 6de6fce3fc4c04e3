"""Detection: files and rules to manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lines, locks, presence, source_code, web
from ..operators.documents import nodes as nodes_of
from ..operators.select import DEFAULT_IGNORED, candidates, not_ignored
from ..rules import FORMATS, Ruleset, builtin_rules
from ..schema import DEP_FIELDS, DEPENDENCY, FILE, KEY
from ..storage import FILE_ROWS, PART_ROWS, kept


class DetectionError(RuntimeError):
    pass


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def outcomes(rows: DataFrame, rules: Ruleset, contents: DataFrame) -> DataFrame:
    """(root, path, ordinal, matched, has_dependencies, dependencies, warnings, error) per row of candidates(). Only the
    readers that the ruleset uses are in the plan. contents: where included files are looked up."""
    used = {r.parser for r in rules.rules}
    plain = [p for p in used if p not in (None, *FORMATS)]
    lazy = "content" not in contents.columns
    found, deps, notes = [], [], []

    def add(f=None, d=None, w=None):
        for to, x in ((found, f), (deps, d), (notes, w)):
            if x is not None:
                to.append(x)

    if lazy:
        add(presence.found_rows(rows.where("unread is not null"), F.lit(False), F.lit(None), F.col("unread")))
        rows = rows.where("unread is null")
    if None in used:
        add(presence.found_rows(rows.where("parser = ''"), F.lit(True), F.lit(None)))
    if used & set(FORMATS):
        source = rows
        if "yarn-lock" in used:
            kind = locks.yarn_kind(F.col("content"))
            yarn = rows.where("parser = 'yarn-lock'").withColumn("kind", kind)
            add(*locks.yarn_classic(yarn.where("kind = 'classic'").drop("kind")))
            source = rows.where("parser <> 'yarn-lock'").unionByName(yarn.where("kind = 'modern'").drop("kind"))
        nodes = kept(nodes_of(source, presence.reaches(rules)), PART_ROWS)
        if used & {"json", "xml", "yaml", "toml"}:
            add(presence.presence(nodes, rules))
        if any(r.params.get("exists") for r in rules.using("yaml")):
            add(presence.existence(nodes, rules))
        if any(r.params.get("query") for r in rules.using("yaml")):
            add(*presence.yaml_queries(nodes, rules))
        if any(r.params.get("queries") or r.params.get("table-queries") for r in rules.using("toml")):
            add(*presence.toml_queries(nodes, rules))
        if "ini" in used:
            add(*presence.ini_queries(nodes, rules))
        for name, reader in locks.READERS.items():
            if name in used:
                add(*reader(nodes))
    if "go-mod" in plain:
        add(*lines.go_mod(rows.where("parser = 'go-mod'")))
    if "py-requirements" in plain:
        add(*lines.requirements(rows.where("parser = 'py-requirements'"), contents))
    if "banner-regex" in plain:
        add(*web.banners(rows, rules))
    if "html" in plain:
        add(*web.external_scripts(rows))
    if set(plain) & set(source_code.MATCHERS):
        add(*source_code.literal_sources(rows, rules))

    out = _union(found)
    listed = _union(deps)
    if listed is not None:
        listed = _collected(listed)
        out = out.join(listed, KEY, "left")
    else:
        out = out.withColumn("dependencies", F.lit(None).cast(f"array<{DEPENDENCY}>"))
    noted = _union(notes)
    if noted is not None:
        noted = noted.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seat", "warning"))).alias("w")).select(*KEY, F.transform("w", lambda x: x["warning"]).alias("warnings"))
        out = out.join(noted, KEY, "left")
    else:
        out = out.withColumn("warnings", F.lit(None).cast("array<string>"))
    some = F.coalesce(F.size("dependencies") > 0, F.lit(False))
    return out.select(*KEY, F.when(F.col("error").isNotNull(), F.lit(False)).otherwise(F.coalesce("matched", some)).alias("matched"), F.when(F.col("error").isNull(), F.when(some, F.lit(True)).otherwise(F.col("absent"))).alias("has_dependencies"), F.when(some, F.col("dependencies")).alias("dependencies"), "warnings", "error")


def _collected(deps: DataFrame) -> DataFrame:
    """Dependencies per file and rule, by seat. Maps do not sort, so extras travel as entries."""
    flat = deps.withColumn("extras", F.map_entries("extras"))
    got = flat.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seat", *DEP_FIELDS))).alias("d"))
    # seats differ within a file; equal rows come of a path that is given twice, and stand side by side
    got = got.select(*KEY, F.filter("d", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(F.col("d"), i - 1))).alias("d"))
    back = lambda x: F.struct(*[(F.when(x[f].isNotNull(), F.map_from_entries(x[f])) if f == "extras" else x[f]).alias(f) for f in DEP_FIELDS])
    return got.select(*KEY, F.transform("d", back).alias("dependencies"))


def _first(rows: DataFrame, rules: Ruleset, contents: DataFrame, on_error: str) -> DataFrame:
    """(root, path, m): of each file's candidates the first that matches or, unless errors are skipped, fails. Where files have several
    candidates, all first ones are read, then the second ones of the files that are left, and so on, each time by the readers that are asked for."""
    fails = F.col("error").isNotNull() if on_error != "skip" else F.lit(False)
    best = F.min_by(F.struct("ordinal", "matched", "has_dependencies", F.col("dependencies"), "warnings", "error"), "ordinal").alias("m")
    first = lambda some, by: outcomes(some, by, contents).where(F.col("matched") | fails).groupBy(*FILE).agg(best)
    several = len({r.parser for r in rules.rules} - {None}) > 1
    # rows that several readers, or several branches of one, would work out again, and rows that Python reads: a table of few bytes is few tasks', its files are work for many
    if several or "content" not in contents.columns or rules.using("py-requirements", "go-mod", *FORMATS, *source_code.MATCHERS):
        rows = kept(rows, FILE_ROWS)
    if not several:
        return first(rows, rules)
    asked = {r["rank"]: r["ordinals"] for r in rows.groupBy("rank").agg(F.collect_set("ordinal").alias("ordinals")).collect()}
    some = {rank: Ruleset(tuple(r for r in rules.rules if r.ordinal in ordinals)) for rank, ordinals in sorted(asked.items())}
    if len(some) < 2:
        return first(rows, some.get(0, Ruleset(rules.rules[:1])))
    parts: list[DataFrame] = []
    for rank, by in some.items():
        now = rows.where(F.col("rank") == rank)
        if parts:
            done = reduce(lambda a, b: a.union(b), [p.select(*FILE) for p in parts])
            now = kept(now.join(done, now["root"].eqNullSafe(done["root"]) & (now["path"] == done["path"]), "left_anti"), FILE_ROWS)
            if now.isEmpty():
                continue
        parts.append(kept(first(now, by)))
    return reduce(lambda a, b: a.union(b), parts)


def detect(files: DataFrame, rules: Ruleset | None = None, ignored: tuple[str, ...] = DEFAULT_IGNORED, on_error: str = "fail", globs: bool = True, contents: DataFrame | None = None) -> DataFrame:
    """MANIFESTS of files (root, path, name, content): per file the first rule by ordinal that matches. Files may be a LISTING, without contents: then
    only those files are opened whose name and path a rule with a reader accepts, and those that they include; one that cannot be read is an error.

    A document that cannot be read ends the job, unless an earlier rule matched; with on_error='skip' it falls through to later
    rules, and with 'warn' it becomes a manifest of unknown status whose warning says why. Files under ignored folders are left
    out, but requirements files may include them. Paths are relative to the root; where they are not, globs=False leaves rules with a path glob
    out. A null root is the root ''. A row with the path '' stands for a name alone: only rules without a reader see it. Rows without a path are
    dropped; contents is where included files are looked up, by default files. Equal rows of one path count once, different ones as one file with the dependencies of both."""
    if on_error not in ("fail", "skip", "warn"):
        raise ValueError(f"on_error: {on_error}")
    rules = rules or builtin_rules()
    plain = lambda x: x.select(F.coalesce("root", F.lit("")).alias("root"), "path", F.col("name") if "name" in x.columns else F.lit(None).cast("string").alias("name"), *(["content"] if "content" in x.columns else [])).where("path is not null")
    rows = plain(files)
    kept_rows = rows.where(not_ignored(F.regexp_replace("path", r"\\", "/"), ignored))
    first = _first(candidates(kept_rows, rules, globs), rules, rows if contents is None else plain(contents), on_error)
    types = F.create_map(*[x for r in rules.rules for x in (F.lit(r.ordinal), F.lit(r.type))])
    error = F.col("m.error")
    stop = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("detection failed: "), error))).otherwise(types[F.col("m.ordinal")])
    kind = stop if on_error == "fail" else types[F.col("m.ordinal")]
    warnings = F.when(error.isNotNull(), F.array(error)).otherwise(F.col("m.warnings"))
    return first.select(*FILE, kind.alias("type"), F.col("m.dependencies").alias("dependencies"), F.col("m.has_dependencies").alias("has_dependencies"), warnings.alias("warnings"))

