"""Tables made of manifests: dependencies, status, summary, sections, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEP_FIELDS, FILE


def status(dependencies: Column | None = None, has: Column | None = None) -> Column:
    """extracted, unknown, present-not-extracted or empty."""
    d, h = F.col("dependencies") if dependencies is None else dependencies, F.col("has_dependencies") if has is None else has
    return F.when(F.coalesce(F.size(d), F.lit(0)) > 0, "extracted").when(h.isNull(), "unknown").when(h, "present-not-extracted").otherwise("empty")


def label() -> Column:
    n = F.coalesce(F.size("dependencies"), F.lit(0))
    s = status()
    return F.when(s == "extracted", F.concat(F.lit("["), n.cast("string"), F.when(n == 1, " dep]").otherwise(" deps]"))).when(s == "empty", "[no dependencies]").when(s == "present-not-extracted", "[dependencies present, not extracted]").otherwise("[matched]")


def dependencies(manifests: DataFrame) -> DataFrame:
    """One row per dependency: root, path, type, pos and its fields."""
    return manifests.select(*FILE, "type", F.posexplode("dependencies").alias("pos", "d")).select(*FILE, "type", "pos", *[F.col(f"d.{f}").alias(f) for f in DEP_FIELDS])


def summary(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("root", status().alias("status")).agg(F.count("*").alias("manifests"))


def visible(manifests: DataFrame, show_empty: bool = False) -> DataFrame:
    return manifests if show_empty else manifests.where(status() != "empty")


def display(d: Column) -> Column:
    name, version, constraint = (F.coalesce(d[x], F.lit("")) for x in ("name", "version", "constraint"))
    return F.when((name != "") & (version != ""), F.concat(name, F.lit("@"), version)).when(name != "", F.concat(name, constraint)).otherwise(F.coalesce(d["raw"], F.lit("")))


DEFAULT_GROUP = "[default group]"


def sections(manifests: DataFrame) -> DataFrame:
    """(root, path, section, first_pos, displays): dependencies by section, in the order of each section's first one."""
    rows = manifests.select(*FILE, F.posexplode("dependencies").alias("pos", "d"))
    name = F.when(F.coalesce(F.col("d.section"), F.lit("")) == "", DEFAULT_GROUP).otherwise(F.col("d.section"))
    return rows.groupBy(*FILE, name.alias("section")).agg(F.min("pos").alias("first_pos"), F.sort_array(F.collect_list(F.struct("pos", display(F.col("d")).alias("shown")))).alias("s")).select(*FILE, "section", "first_pos", F.transform("s", lambda x: x["shown"]).alias("displays"))


def package_usage(manifests: DataFrame) -> DataFrame:
    """(name, manifests, uses, versions): an extension across repositories. A file is one row of manifests, so its first use of a name is found within
    the row, and what is grouped grows with names and versions, not with files. Partial sums come before the shuffle."""
    named = F.filter("dependencies", lambda d: d["name"].isNotNull())
    uses = manifests.select(F.sort_array(F.transform(named, lambda d: F.struct(d["name"].alias("name"), d["version"].alias("version")))).alias("u"))
    first = lambda d, i: (i == 0) | (d["name"] != F.get(F.col("u"), i - 1)["name"])
    each = uses.select(F.explode(F.transform("u", lambda d, i: F.struct(d["name"].alias("name"), d["version"].alias("version"), first(d, i).cast("long").alias("first")))).alias("d")).select("d.*")
    by_version = each.groupBy("name", "version").agg(F.sum("first").alias("manifests"), F.count("*").alias("uses"))
    return by_version.groupBy("name").agg(F.sum("manifests").alias("manifests"), F.sum("uses").alias("uses"), F.count("version").alias("versions"))


def register(manifests: DataFrame, files: DataFrame | None = None) -> None:
    """Views manifests, dependencies and, if given, files for SQL."""
    manifests.createOrReplaceTempView("manifests")
    dependencies(manifests).createOrReplaceTempView("dependencies")
    if files is not None:
        files.createOrReplaceTempView("files")
