"""Line-based readers: go.mod and Python requirements, with includes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_path, parent_of, pep508, quoted, tidy
from ..schema import KEY
from ..sources.contents import opened
from ..storage import FILE_ROWS, PART_ROWS, kept
from .presence import dep_rows, found_rows

#: Options whose lines are not dependencies, and options that include a file.
DIRECTIVES = ("-c", "--constraint", "--index-url", "--extra-index-url", "--find-links", "--trusted-host", "--hash")
INCLUDES = ("-r", "--requirement", "--requirements")
#: Directives of go.mod, and those that may head a block.
GO_DIRECTIVES = ("exclude", "go", "godebug", "ignore", "module", "replace", "require", "retract", "tool", "toolchain")
GO_BLOCKS = ("exclude", "godebug", "ignore", "module", "replace", "require", "retract", "tool")
#: Included files that are broadcast by path; beyond, files are shuffled by path.
MOST_BROADCAST = 500_000


def go_mod(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All requirements in order; `// indirect` is their section. A requirement without a version, an unknown directive or block and a
    bracket without its other half are errors."""
    lines = rows.select(*KEY, F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))
    code = tidy(F.regexp_replace("text", "//.*$", ""))
    lines = lines.withColumn("code", code).withColumn("note", tidy(F.regexp_extract("text", "//(.*)$", 1)))
    edge = F.when(F.col("code").rlike(r"^\w+\s*\(\z"), F.regexp_extract("code", r"^(\w+)", 1)).when(F.col("code") == ")", "")
    w = Window.partitionBy(*KEY).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.withColumn("in", F.last(edge, ignorenulls=True).over(w)).withColumn("edge", edge.isNotNull())
    single = F.regexp_extract("code", r"^require\s+([^(\s].*)\z", 1)
    spec = F.when((F.col("in") == "require") & ~F.col("edge") & (F.col("code") != ""), F.col("code")).when((F.coalesce("in", F.lit("")) == "") & (single != ""), single)
    wanted = inside.withColumn("spec", spec).where("spec is not null")
    bare = lambda g: F.regexp_replace(F.regexp_extract("spec", r"^(\S+)\s+(\S+)\z", g), "^[\"`]|[\"`]$", "")
    own = wanted.withColumn("name", bare(1)).withColumn("version", bare(2))
    top, word = F.coalesce("in", F.lit("")) == "", F.regexp_extract("code", r"^([^\s(]*)", 1)
    last = F.last(edge, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wrong = (
        F.when(F.col("edge") & (F.col("code") != ")"), F.when(~top, F.concat(F.lit("block within a block: "), "code")).when(~word.isin(*GO_BLOCKS), F.concat(F.lit("unknown block type: "), word)))
        .when(top & (F.col("code") == ")"), F.lit("unexpected )"))
        .when(top & (F.col("code") != "") & ~word.isin(*GO_DIRECTIVES), F.concat(F.lit("unknown directive: "), word))
        .when((F.col("line") == 0) & (last != ""), F.concat(F.lit("unclosed block: "), last))
    )
    faults = inside.select(*KEY, wrong.alias("e")).where("e is not null").unionByName(own.where("name = ''").select(*KEY, F.concat(F.lit("unexpected requirement: "), "spec").alias("e")))
    bad = faults.groupBy(*KEY).agg(F.min("e").alias("e"))
    section = F.when(F.col("note").rlike(r"^indirect(;|\z)"), "indirect")
    return found_rows(rows.join(bad, KEY, "left"), F.lit(True), F.lit(False), F.col("e")), dep_rows(own, F.format_string("%09d", "line"), raw=F.col("name"), name=F.col("name"), version=F.col("version"), section=section)


def logical_lines(content: Column) -> Column:
    """Lines of a requirements file, with those that end in a backslash joined to the next by one space."""
    text = F.regexp_replace(content.cast("string"), r"(?:[ \t]*\\[ \t]*\r?\n)+[ \t]*", " ")
    return F.transform(F.split(F.regexp_replace(text, r"[ \t]*\\[ \t]*\r?\z", ""), r"\r?\n"), tidy)


def _option(options: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(options) + r")(?:[ \t=](.*))?\z"


def _split(files: DataFrame) -> DataFrame:
    """Lines that count of (KEY, stack, seat, content): kind dep or include."""
    lines = files.select(*KEY, "stack", "seat", F.posexplode(logical_lines(F.col("content"))).alias("line", "text")).where("text <> '' and not startswith(text, '#')")
    target = tidy(F.regexp_extract("text", _option(INCLUDES), 1))
    return lines.withColumn("target", F.when(target != "", target)).where(F.col("target").isNotNull() | ~F.col("text").rlike(_option(DIRECTIVES))).withColumn("seat", F.concat("seat", F.format_string("%07d", "line")))


def requirements(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FOUND, DEPS and NOTES of requirements files. Includes are expanded in place, level by level: the lines of a level that
    include are joined with files (root, path, content), which also holds files that no rule selects; of a LISTING, those that are included are opened.
    A file that includes itself, directly or through others, or one that is not in files gives a warning. Paths that lead out
    of the root are not in files."""
    level = rows.select(*KEY, F.array("path").alias("stack"), F.lit("").alias("seat"), "content")
    deps, notes = [], []
    lazy = "content" not in files.columns
    content = files.select("root", F.regexp_replace("path", r"\\", "/").alias("aim"), "path" if lazy else "content")
    while True:
        lines = kept(_split(level), PART_ROWS)
        deps.append(lines.where("target is null"))
        more = lines.where("target is not null").withColumn("aim", clean_path(F.concat_ws("/", parent_of(F.element_at("stack", -1)), "target")))
        if more.isEmpty():
            break
        cycle = F.array_contains("stack", F.col("aim"))
        full = F.concat_ws("/", "root", "aim")
        notes.append(more.where(cycle).select(*KEY, "seat", F.concat(F.lit("detected requirements include cycle for "), quoted(full), F.lit(" via "), quoted(F.col("target"))).alias("warning")))
        # the few files that are included are found by path before any content is joined
        aims = kept(more.where(~cycle).select("root", "aim").distinct())
        wanted = content.join(F.broadcast(aims) if aims.count() <= MOST_BROADCAST else aims, ["root", "aim"], "left_semi")
        if lazy:
            wanted = opened(wanted, F.lit(None)).drop("path", "unread")
        met = more.where(~cycle).join(wanted, ["root", "aim"], "left")
        notes.append(met.where("content is null").select(*KEY, "seat", F.concat(F.lit("could not read included requirements file "), quoted(F.col("target")), F.lit(": open "), full, F.lit(": no such file or directory")).alias("warning")))
        level = kept(met.where("content is not null").select(*KEY, F.concat("stack", F.array("aim")).alias("stack"), "seat", "content"), FILE_ROWS)
    every = reduce(lambda a, b: a.unionByName(b), deps)
    name, rest = pep508(F.col("text"))
    out = dep_rows(every, F.col("seat"), raw=F.col("text"), name=name, constraint=rest)
    warned = reduce(lambda a, b: a.unionByName(b), notes) if notes else None
    if warned is None:
        return found_rows(rows, F.lit(True)), out, None
    # without dependencies, a warning leaves the status unknown
    noted = warned.select(*KEY).distinct().withColumn("noted", F.lit(True))
    return found_rows(rows.join(noted, KEY, "left"), F.lit(True), F.when(F.col("noted").isNull(), F.lit(False))), out, warned
