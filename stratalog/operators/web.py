"""Banners of scripts and external scripts of pages, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_regex, tidy
from ..rules import Ruleset
from ..schema import KEY
from .presence import dep_rows, found_rows

#: What counts as a script block, its attributes and imports.
SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
SRC = r"""(?is)\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)')"""
TYPE = r"""(?is)\btype\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
IMPORT = r"""(?is)\bimport\s+(?:[^"'()]+?\s+from\s+)?(?:"(https?://[^"]+)"|'(https?://[^']+)')"""
MAP_IMPORTS = r'(?is)"imports"\s*:\s*\{(.*?)\}'
MAP_URL = r'(?is)"[^"]+"\s*:\s*"(https?://[^"]+)"'


def banners(rows: DataFrame, rules: Ruleset) -> tuple[DataFrame, DataFrame]:
    """name@version of the first match of each rule's pattern in the first 4096 bytes."""
    text = F.substring("content", 1, 4096).cast("string")
    name, version = F.lit(None), F.lit(None)
    for r in rules.using("banner-regex"):
        own, pattern = F.col("ordinal") == r.ordinal, java_regex(r.params["pattern"])
        name, version = F.when(own, F.regexp_extract(text, pattern, 1)).otherwise(name), F.when(own, F.regexp_extract(text, pattern, 2)).otherwise(version)
    got = rows.where("parser = 'banner-regex'").withColumn("n", name).withColumn("v", version)
    return found_rows(got, F.lit(None), F.lit(None)), dep_rows(got.where("n <> '' and v <> ''"), F.lit("0"), raw=F.concat("n", F.lit("@"), "v"))


def script_blocks(text) -> F.Column:
    return F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(0))


def external_scripts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remote addresses of scripts: of src, else of an import map, else of static imports; pages without any do not match."""
    own = rows.where("parser = 'html'")
    blocks = own.select(*KEY, F.posexplode(script_blocks(F.col("content").cast("string"))).alias("i", "block"))
    parts = blocks.select(*KEY, "i", F.regexp_extract("block", SCRIPT, 1).alias("attrs"), F.regexp_extract("block", SCRIPT, 2).alias("body"))
    first = lambda x, pattern, n: F.concat(*[F.coalesce(F.regexp_extract(x, pattern, g), F.lit("")) for g in range(1, n + 1)])
    src, kind = tidy(first("attrs", SRC, 2)), F.lower(first("attrs", TYPE, 3))
    maps = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(MAP_IMPORTS), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(MAP_URL), F.lit(1))))
    imports = F.transform(F.regexp_extract_all("body", F.lit(IMPORT), F.lit(0)), lambda m: first(m, IMPORT, 2))
    urls = F.when(first("attrs", SRC, 2) != "", F.filter(F.array(src), lambda u: u.rlike("^https?://"))).when(kind == "importmap", maps).otherwise(imports)
    found = parts.select(*KEY, "i", F.posexplode(urls).alias("j", "url")).withColumn("url", tidy(F.col("url"))).where("url <> ''")
    return found_rows(own, F.lit(None), F.lit(None)), dep_rows(found, F.format_string("%07d%07d", "i", "j"), raw=F.col("url"))
