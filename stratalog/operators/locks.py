"""Lockfile readers: packages are groups of document nodes.

Every reader gives FOUND and DEPS. Nodes are dealt by file once; all groupings and joins below use that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ANY_KEY, ITEM, I, K
from ..functions.text import blank_to_null, tidy
from ..schema import KEY
from .presence import dep_rows, found_rows

SECTIONS = ("dependencies", "devDependencies", "optionalDependencies")


def of(nodes: DataFrame, parser: str) -> DataFrame:
    return nodes.where(F.col("parser") == parser)


def packages(nodes: DataFrame, item: str, **leaves: str) -> DataFrame:
    """(KEY, item, own, a column per leaf): nodes grouped by the place of the item that they are in; own is the item's
    own value, if it is a scalar. leaves: the places below the item, steps joined by '/'."""
    inside = nodes.select(*KEY, F.regexp_extract("at", f"^({item})(?:{K}.*)?\\z", 1).alias("item"), F.regexp_extract("at", f"^{item}{K}?(.*)\\z", 1).alias("leaf"), "kind", "value").where("item <> ''")
    scalar = ~F.col("kind").isin("object", "array", "null")
    mine = inside.where(F.col("leaf").isin("", *[v.replace("/", K) for v in leaves.values()]))
    return mine.groupBy(*KEY, "item").agg(
        F.max(F.when((F.col("leaf") == "") & scalar, F.col("value"))).alias("own"),
        *[F.max(F.when((F.col("leaf") == v.replace("/", K)) & scalar, F.col("value"))).alias(k) for k, v in leaves.items()],
    )


def files(nodes: DataFrame, matched: Column, absent: bool | None = False) -> DataFrame:
    """FOUND: matched is an aggregate over a file's nodes."""
    error = F.max(F.when(F.col("kind") == "error", F.col("value")))
    return found_rows(nodes.groupBy(*KEY).agg(matched.alias("m"), error.alias("e")), F.coalesce("m", F.lit(False)), F.lit(absent), F.col("e"))


def some(condition: str) -> Column:
    return F.max(F.expr(condition))


def at(*steps: str) -> str:
    return "at = '" + "".join(K + s for s in steps) + "'"


def first_of(deps: DataFrame, *by: str) -> DataFrame:
    """One row per file and value of by (raw, unless given): the first by seat."""
    by = (*KEY, *(by or ("raw",)))
    rest = [c for c in deps.columns if c not in by]
    return deps.groupBy(*by).agg(F.min_by(F.struct(*rest), "seat").alias("d")).select(*by, "d.*").select(*deps.columns)


def versioned(name: Column, version: Column, sep: str = "@") -> Column:
    return F.when(F.coalesce(version, F.lit("")) != "", F.concat(name, F.lit(sep), version)).otherwise(name)


def pairs(**values: Column) -> Column:
    """A map of the values that are not null or empty; null if none is."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def after_last(x: Column, sep: str) -> Column:
    return F.substring_index(x, sep, -1)


def before_last(x: Column, sep: str) -> Column:
    return F.regexp_replace(x, f"{sep}[^{sep}]*\\z", "")


def cargo(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "cargo-lock")
    p = packages(n, f"{K}package{ITEM}", name="name", version="version", origin="source", checksum="checksum").where("name <> '' and version <> ''")
    origin = blank_to_null(F.col("origin"))
    git = F.regexp_replace(origin, r"^git\+", "")
    kind = F.when(origin.startswith("registry+"), "registry").when(origin.startswith("git+"), "git").when(origin.isNotNull(), "url")
    url = F.when(kind == "registry", F.regexp_replace(origin, r"^registry\+", "")).when(kind == "git", F.when(git.contains("#"), before_last(git, "#")).otherwise(git)).otherwise(origin)
    ref = F.when((kind == "git") & git.contains("#"), after_last(git, "#"))
    deps = dep_rows(p, F.col("item"), raw=versioned(F.col("name"), F.col("version")), name=F.col("name"), version=F.col("version"), source=kind, extras=pairs(checksum=F.col("checksum"), source_url=url, source_ref=ref))
    return files(n, some(f"{at('version')} and kind = 'int'")), deps


def poetry(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "poetry-lock")
    p = packages(n, f"{K}package{ITEM}", name="name", version="version", kind="source/type", url="source/url", ref="source/reference").where("name <> ''")
    git = F.coalesce(tidy(F.col("kind")) == "git", F.lit(False))
    own = F.coalesce((tidy(F.col("kind")) == "directory") & tidy(F.coalesce("url", F.lit(""))).isin(".", "./"), F.lit(False))
    kept = p.where(git | ~own & (F.coalesce("version", F.lit("")) != ""))
    deps = dep_rows(
        kept, F.col("item"), raw=F.when(git, F.col("name")).otherwise(versioned(F.col("name"), F.col("version"), "==")), name=F.col("name"), version=F.when(~git, F.col("version")),
        source=F.when(git, "git"), extras=F.when(git, pairs(source_url=tidy(F.col("url")), source_ref=tidy(F.col("ref")))),
    )
    there = some(f"(at rlike '^{K}package{ITEM.replace(chr(92), chr(92) * 2)}$') or (size > 0 and ({at('metadata', 'lock-version')} or {at('metadata', 'python-versions')} or {at('metadata', 'content-hash')}))")
    return files(n, there), first_of(deps.withColumn("source", F.coalesce("source", F.lit(""))), "raw", "source").withColumn("source", blank_to_null(F.col("source")))


def uv(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "uv-lock")
    p = packages(n, f"{K}package{ITEM}", name="name", version="version", editable="source/editable", workspace="source/workspace", virtual="source/virtual", local="source/path").where("name <> ''")
    gone = tidy(F.coalesce("editable", F.lit(""))).isin(".", "./") | (F.coalesce("workspace", F.lit("")) == "true") | F.col("virtual").isNotNull()
    local = F.col("local").isNotNull()
    kept = p.where(~gone & (local | (F.coalesce("version", F.lit("")) != "")))
    deps = dep_rows(kept, F.col("item"), raw=F.when(local, F.col("name")).otherwise(versioned(F.col("name"), F.col("version"), "==")), name=F.col("name"), version=F.when(~local, F.col("version")), source=F.when(local, "path"))
    return files(n, some(f"{at('version')} and kind = 'int'")), deps


def pipfile(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "pipfile-lock")
    p = packages(n, f"{K}(?:default|develop){K}[^{K}{I}]+", version="version")
    section, name = F.get(F.split("item", K), F.lit(1)), F.get(F.split("item", K), F.lit(2))
    raw = F.concat(name, F.coalesce("version", F.lit("")))
    deps = dep_rows(p, F.concat(section, F.lit(K), raw), raw=raw, name=name, version=blank_to_null(F.regexp_replace("version", "^==", "")), section=section)
    return files(n, some(f"kind <> 'null' and ({at('_meta')} or {at('default')} or {at('develop')})")), deps


def composer(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "composer-lock")
    p = packages(n, f"{K}packages(?:-dev)?{ITEM}", name="name", version="version", kind="type").where("name <> ''")
    section = F.regexp_extract("item", f"^{K}(packages(?:-dev)?)", 1)
    raw = versioned(F.col("name"), F.col("version"))
    deps = first_of(dep_rows(p, F.col("item"), raw=raw, name=F.col("name"), version=blank_to_null(F.col("version")), section=section, extras=pairs(package_type=F.col("kind"))), "section", "raw")
    return files(n, some(f"kind = 'array' and ({at('packages')} or {at('packages-dev')})")), deps.withColumn("seat", F.concat("section", F.lit(K), "raw"))


def npm(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Version 1 walks nested dependencies; versions 2 and 3 read the packages map and look sections up by name in the root's maps."""
    n = of(nodes, "package-lock")
    format_ = n.where(f"{at('lockfileVersion')} and kind = 'int'").select(*KEY, F.col("value").cast("int").alias("lock"))
    nested = packages(n, f"(?:{K}dependencies{K}[^{K}{I}]+)+", version="version").join(format_.where("lock = 1"), KEY)
    name = F.substring_index("item", K, -1)
    v1 = first_of(dep_rows(nested, F.col("item"), raw=versioned(name, F.col("version")), name=name, version=blank_to_null(F.col("version"))))
    flat = format_.where("lock in (2, 3)")
    listed = packages(n, f"{K}packages{ANY_KEY}", version="version").join(flat, KEY).withColumn("where", F.get(F.split("item", K), F.lit(2)))
    in_root = n.select(*KEY, F.split("at", K).alias("s")).where(F.get("s", F.lit(1)).eqNullSafe("packages") & (F.size("s") == 5) & (F.get("s", F.lit(2)) == "") & F.get("s", F.lit(3)).isin(*SECTIONS) & (F.get("s", F.lit(4)) != ""))
    rank = F.when(F.get("s", F.lit(3)) == SECTIONS[0], "0").when(F.get("s", F.lit(3)) == SECTIONS[1], "1").otherwise("2")
    root = in_root.groupBy(*KEY, F.get("s", F.lit(4)).alias("name")).agg(F.min(F.struct(rank.alias("rank"), F.get("s", F.lit(3)).alias("section"))).alias("r"))
    tail = F.regexp_extract("where", r"^(?:.*)node_modules/(.*)\z", 1)
    named = listed.where("where <> ''").withColumn("name", F.when(tail.startswith("@") & tail.contains("/"), F.substring_index(tail, "/", 2)).otherwise(F.substring_index(tail, "/", 1)))
    full = named.where("name <> ''").join(root, [*KEY, "name"], "left")
    flat_deps = dep_rows(full, F.col("where"), raw=versioned(F.col("name"), F.col("version")), name=F.col("name"), version=blank_to_null(F.col("version")), section=F.col("r.section"))
    only_root = root.join(flat, KEY).join(listed.where("where <> ''").select(*KEY).distinct(), KEY, "left_anti")
    root_deps = dep_rows(only_root, F.concat(F.col("r.rank"), "name"), raw=F.col("name"), name=F.col("name"), section=F.col("r.section"))
    return files(n, some(f"{at('lockfileVersion')} and kind = 'int' and value in ('1', '2', '3')")), v1.unionByName(flat_deps).unionByName(root_deps)


def pnpm(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root importer's sections, or the top level's; then stored packages whose raw text these have not."""
    n = of(nodes, "pnpm-lock")
    names = "|".join(SECTIONS)
    direct = packages(n, f"(?:{K}importers{K}\\.)?{K}(?:{names}){K}[^{K}{I}]+", version="version", specifier="specifier")
    rooted = n.where(at("importers", ".")).select(*KEY, F.lit(True).alias("rooted")).distinct()
    inner = F.col("item").startswith(f"{K}importers{K}")
    direct = direct.join(rooted, KEY, "left").where(F.coalesce("rooted", F.lit(False)) == inner)
    section, name = F.element_at(F.split("item", K), -2), F.substring_index("item", K, -1)
    version, spec = blank_to_null(F.coalesce("own", "version")), blank_to_null(F.col("specifier"))
    rank = F.when(section == SECTIONS[0], "0").when(section == SECTIONS[1], "1").otherwise("2")
    own = dep_rows(direct, F.concat(F.lit("0"), rank, name), raw=versioned(name, F.coalesce(version, spec)), name=name, version=version, constraint=F.when(version.isNull(), spec), section=section, extras=F.when(version.isNotNull(), pairs(specifier=spec)))
    stored = n.where(F.col("at").rlike(f"^{K}packages{K}[^{K}{I}]+\\z")).withColumn("full", F.get(F.split("at", K), F.lit(2))).withColumn("k", F.when(F.col("full").contains("("), tidy(F.substring_index("full", "(", 1))).otherwise(F.col("full")))
    old = F.regexp_extract("k", r"^/(.*)\z", 1)
    cut = F.col("k").startswith("/")
    p_name = F.when(cut, F.when(old.contains("/"), F.regexp_replace(old, r"/[^/]*\z", "")).otherwise(old)).otherwise(F.when(F.col("k").rlike(r"^.[^@]*.*@[^@]*\z") & (F.regexp_extract("k", r"^(.+)@[^@]*\z", 1) != "") & ~F.col("k").rlike(r"^@@?[^@]*\z"), F.regexp_extract("k", r"^(.+)@[^@]*\z", 1)).otherwise(F.col("k")))
    p_version = F.when(cut, F.when(old.contains("/"), after_last(old, "/"))).when(p_name != F.col("k"), after_last(F.col("k"), "@"))
    more = dep_rows(stored.withColumn("n", p_name).where("n <> ''"), F.concat(F.lit("1"), "full"), raw=versioned(F.col("n"), p_version), name=F.col("n"), version=blank_to_null(p_version))
    more = first_of(more).join(own.select(*KEY, "raw").distinct(), [*KEY, "raw"], "left_anti").select(*own.columns)
    return files(n, some(f"{at('lockfileVersion')} and coalesce(value, '') <> ''")), own.unionByName(more)


#: Text that opens the two kinds of yarn.lock.
YARN_CLASSIC, YARN_MODERN, YARN_NOTICE = "# yarn lockfile v1", "__metadata:", "# THIS IS AN AUTOGENERATED FILE. DO NOT EDIT THIS FILE DIRECTLY.\n"


def yarn_text(content: Column) -> Column:
    text = F.regexp_replace(tidy(content.cast("string")), "^\\x{FEFF}+", "")
    return F.when(text.startswith(YARN_NOTICE), F.substr(text, F.lit(len(YARN_NOTICE) + 1))).otherwise(text)


def yarn_kind(content: Column) -> Column:
    """classic, modern, or null for neither."""
    text = yarn_text(content)
    return F.when(text.startswith(YARN_CLASSIC), "classic").when(F.regexp_replace(text, r"^(?:[^\S\n]*(?:#[^\n]*)?(?:\n|\z))+", "").startswith(YARN_MODERN), "modern")


def selector_name(x: Column) -> Column:
    """What comes before the first @ that does not open the selector."""
    return F.regexp_extract(F.regexp_replace(x, '^"+|"+$', ""), r"^(@?[^@]*)", 1)


def yarn_modern(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = of(nodes, "yarn-lock")
    p = packages(n, f"{K}[^{K}{I}]*", version="version", resolution="resolution").withColumn("selector", F.get(F.split("item", K), F.lit(1))).where("selector <> '__metadata'")
    parts = F.filter(F.transform(F.split("selector", ","), lambda s: selector_name(tidy(s))), lambda s: s != "")
    name = F.coalesce(blank_to_null(selector_name(F.coalesce("resolution", F.lit("")))), F.get(parts, F.lit(0)))
    named = p.withColumn("name", name).where("name <> ''")
    deps = first_of(dep_rows(named, F.col("item"), raw=versioned(F.col("name"), F.col("version")), name=F.col("name"), version=blank_to_null(F.col("version"))))
    odd = F.max(F.when(F.col("at").rlike(f"^{K}[^{K}{I}]*\\z") & (F.col("kind") != "object"), F.lit("expected mapping node")).when(F.col("kind") == "error", F.col("value")))
    found = n.groupBy(*KEY).agg(odd.alias("e"))
    return found_rows(found, F.lit(True), F.lit(False), F.col("e")), deps.withColumn("seat", F.col("raw"))


def yarn_classic(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A block runs from an unindented line that ends with ':' to the next one or a blank line; its first version line counts for all
    its selectors."""
    lines = rows.select(*KEY, F.posexplode(F.split(yarn_text(F.col("content")), "\n")).alias("line", "text")).withColumn("t", tidy(F.col("text"))).where(~F.col("text").startswith("#"))
    head = ~F.col("text").rlike(r"^[ \t]") & F.col("t").endswith(":")
    block = lines.withColumn("head", head).withColumn("block", F.sum((head | (F.col("t") == "")).cast("int")).over(Window.partitionBy(*KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    version = F.when(F.col("t").startswith("version "), F.struct("line", "t"))
    b = block.groupBy(*KEY, "block").agg(F.max(F.when(F.col("head"), F.col("t"))).alias("head"), F.min("line").alias("line"), F.min(version)["t"].alias("v")).where("head is not null")
    each = b.select(*KEY, "line", F.posexplode(F.split(F.regexp_replace("head", ":$", ""), ",")).alias("i", "s"), F.regexp_replace(tidy(F.regexp_replace("v", "^version", "")), '^"+|"+$', "").alias("version"))
    each = each.withColumn("name", selector_name(tidy(F.col("s")))).where("name <> ''")
    deps = first_of(dep_rows(each, F.format_string("%08d%06d", "line", "i"), raw=versioned(F.col("name"), F.col("version")), name=F.col("name"), version=blank_to_null(F.col("version"))))
    return found_rows(rows, F.lit(True)), deps


READERS = {"cargo-lock": cargo, "poetry-lock": poetry, "uv-lock": uv, "pipfile-lock": pipfile, "composer-lock": composer, "package-lock": npm, "pnpm-lock": pnpm, "yarn-lock": yarn_modern}
