"""The library's operators over virtual corpora: manifests written from the rows of tables, read back by detection.

QUERIES and SQL hold, per name, the query and the SQL that gives its rows straight from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import pep508
from .operators.select import not_ignored, selector_type
from .operators.web import script_blocks
from .plans import views
from .plans.detect import detect
from .plans.report import rendered, write_json
from .rules import builtin_rules, parse_rules
from .sources.tree import files_from_table
from .storage import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def gathered(rows: DataFrame, key: str, order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """(key, body): the rows' lines in order."""
    got = rows.select(key, F.struct(*order, line.alias("line")).alias("x")).groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return got.select(key, F.array_join(F.transform("xs", lambda x: x["line"]), sep).alias("body"))


def found(files: DataFrame, *types: str) -> DataFrame:
    return detect(files, builtin_rules().only(*types))


def listed(files: DataFrame, *types: str, fields: tuple[str, ...] = ("raw", "name")) -> DataFrame:
    return views.dependencies(found(files, *types)).select("path", F.col("pos").cast("long").alias("pos"), *fields)


@query("""
select 'orders/' || l_orderkey || '/requirements.txt' as path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos,
  'part-' || l_partkey || '==' || l_linenumber as raw, 'part-' || l_partkey as name, '==' || l_linenumber as "constraint"
from lineitem
""")
def requirements_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text("part-", F.col("l_partkey"), "==", F.col("l_linenumber"))
    rows = gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], line)
    files = files_from_table(rows, text("orders/", F.col("l_orderkey"), "/requirements.txt"), F.col("body"))
    return listed(files, "python-requirements", fields=("raw", "name", "constraint"))


@query("""
select 'c/' || c_custkey || '/requirements.txt' as path, i as pos, case i when 0 then 'own-' || c_custkey else 'nation-' || c_nationkey || '>=1' end as raw
from customer, (select unnest([0, 1]) as i)
""")
def requirements_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's file includes its nation's file, which no rule selects."""
    c = table(spark, sf_dir, "customer")
    own = files_from_table(c, text("c/", F.col("c_custkey"), "/requirements.txt"), text("own-", F.col("c_custkey"), "\n-r ../../n/", F.col("c_nationkey"), ".list\n"))
    nations = files_from_table(table(spark, sf_dir, "nation"), text("n/", F.col("n_nationkey"), ".list"), text("nation-", F.col("n_nationkey"), ">=1\n-c x"))
    return listed(own.union(nations), "python-requirements", fields=("raw",))


PACKAGE_SQL = """
select 'b/{brand}/{file}' as path, row_number() over (partition by p_brand order by p_partkey) - 1 as pos,
  'part-' || p_partkey || '{sep}' || p_size as raw, 'part-' || p_partkey as name, cast(p_size as varchar) as version from part
""".replace("{brand}", "' || p_brand || '")


def _toml_lock(spark: SparkSession, sf_dir: str, file: str, head: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    block = text('[[package]]\nname = "part-', F.col("p_partkey"), '"\nversion = "', F.col("p_size"), '"\n')
    rows = gathered(part, "p_brand", ["p_partkey"], block)
    return files_from_table(rows, text("b/", F.col("p_brand"), "/", file), text(head, F.col("body")))


@query(PACKAGE_SQL.replace("{file}", "Cargo.lock").replace("{sep}", "@"))
def cargo_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_toml_lock(spark, sf_dir, "Cargo.lock", "version = 3\n"), "rust-cargo-lock", fields=("raw", "name", "version"))


@query(PACKAGE_SQL.replace("{file}", "poetry.lock").replace("{sep}", "=="))
def poetry_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_toml_lock(spark, sf_dir, "poetry.lock", ""), "python-poetry-lock", fields=("raw", "name", "version"))


@query(PACKAGE_SQL.replace("{file}", "uv.lock").replace("{sep}", "=="))
def uv_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_toml_lock(spark, sf_dir, "uv.lock", "version = 1\n"), "python-uv", fields=("raw", "name", "version"))


def _json_map(spark: SparkSession, sf_dir: str, name: Column, value: Column) -> DataFrame:
    """(s_nationkey, body): suppliers of a nation as entries of a JSON object."""
    s = table(spark, sf_dir, "supplier")
    return gathered(s, "s_nationkey", ["s_suppkey"], text('"', name, '": ', value), ", ")


@query("""
select 'n/' || s_nationkey || '/package-lock.json' as path, row_number() over (partition by s_nationkey order by 'node_modules/s' || s_suppkey) - 1 as pos,
  's' || s_suppkey || '@' || (s_suppkey % 7) as raw, case when s_suppkey % 2 = 0 then 'dependencies' end as section
from supplier
""")
def package_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    all_ = _json_map(spark, sf_dir, text("node_modules/s", key), text('{"version": "', key % 7, '"}'))
    even = gathered(table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0"), "s_nationkey", ["s_suppkey"], text('"s', key, '": "*"'), ", ").withColumnRenamed("body", "direct")
    rows = all_.join(even, "s_nationkey", "left")
    body = text('{"lockfileVersion": 3, "packages": {"": {"dependencies": {', F.coalesce("direct", F.lit("")), "}}, ", F.col("body"), "}}")
    return listed(files_from_table(rows, text("n/", F.col("s_nationkey"), "/package-lock.json"), body), "js-npm-lock", fields=("raw", "section"))


@query("""
select 'n/' || s_nationkey || '/Pipfile.lock' as path, row_number() over (partition by s_nationkey order by 's' || s_suppkey || '==' || (s_suppkey % 7)) - 1 as pos,
  's' || s_suppkey || '==' || (s_suppkey % 7) as raw, cast(s_suppkey % 7 as varchar) as version, 'default' as section from supplier
""")
def pipfile_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _json_map(spark, sf_dir, text("s", F.col("s_suppkey")), text('{"version": "==', F.col("s_suppkey") % 7, '"}'))
    return listed(files_from_table(rows, text("n/", F.col("s_nationkey"), "/Pipfile.lock"), text('{"default": {', F.col("body"), "}}")), "python-pipfile-lock", fields=("raw", "version", "section"))


@query("""
select 'n/' || s_nationkey || '/composer.lock' as path, row_number() over (partition by s_nationkey order by 'v/s' || s_suppkey || '@' || (s_suppkey % 7)) - 1 as pos,
  'v/s' || s_suppkey || '@' || (s_suppkey % 7) as raw, 'packages' as section from supplier
""")
def composer_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each package is listed twice; one stays."""
    s = table(spark, sf_dir, "supplier")
    rows = gathered(s.union(s), "s_nationkey", ["s_suppkey"], text('{"name": "v/s', F.col("s_suppkey"), '", "version": "', F.col("s_suppkey") % 7, '"}'), ", ")
    return listed(files_from_table(rows, text("n/", F.col("s_nationkey"), "/composer.lock"), text('{"packages": [', F.col("body"), "]}")), "php-composer-lock", fields=("raw", "section"))


@query("""
select 'r/' || n_regionkey || '/go.mod' as path, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos,
  'x.org/n' || n_nationkey as raw, 'v1.' || n_nationkey || '.0' as version, case when n_nationkey % 2 = 0 then 'indirect' end as section from nation
""")
def go_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = gathered(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], text("\tx.org/n", key, " v1.", key, ".0", F.when(key % 2 == 0, " // indirect").otherwise("")))
    return listed(files_from_table(rows, text("r/", F.col("n_regionkey"), "/go.mod"), text("module m\n\nrequire (\n", F.col("body"), "\n)\n")), "go-mod", fields=("raw", "version", "section"))


@query("""
select 'r/' || n_regionkey || '/yarn.lock' as path, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos, '@s/n' || n_nationkey || '@1.' || n_nationkey as raw from nation
""")
def yarn_lock_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = gathered(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], text('"@s/n', key, '@^1", "@s/n', key, '@~1":\n  version "1.', key, '"\n'))
    return listed(files_from_table(rows, text("r/", F.col("n_regionkey"), "/yarn.lock"), text("# yarn lockfile v1\n\n\n", F.col("body"))), "js-yarn", fields=("raw",))


@query("""
select 'r/' || n_regionkey || '/yarn.lock' as path, row_number() over (partition by n_regionkey order by 'n' || n_nationkey || '@1.' || n_nationkey) - 1 as pos, 'n' || n_nationkey || '@1.' || n_nationkey as raw from nation
""")
def yarn_lock_modern(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = gathered(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], text('"n', key, '@npm:^1":\n  version: 1.', key, "\n"))
    return listed(files_from_table(rows, text("r/", F.col("n_regionkey"), "/yarn.lock"), text("__metadata:\n  version: 8\n\n", F.col("body"))), "js-yarn", fields=("raw",))


@query("""
select 'r/' || n_regionkey || '/pnpm-lock.yaml' as path, row_number() over (partition by n_regionkey order by 'n' || n_nationkey) - 1 as pos,
  'n' || n_nationkey || '@1.' || n_nationkey as raw, 'dependencies' as section, '^1' as specifier from nation
""")
def pnpm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages map repeats the importer's packages, which stay single."""
    key = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    own = gathered(n, "n_regionkey", ["n_nationkey"], text("      n", key, ":\n        specifier: ^1\n        version: 1.", key, "\n"), "")
    stored = gathered(n, "n_regionkey", ["n_nationkey"], text("  n", key, "@1.", key, ": {}\n"), "").withColumnRenamed("body", "stored")
    rows = own.join(stored, "n_regionkey")
    files = files_from_table(rows, text("r/", F.col("n_regionkey"), "/pnpm-lock.yaml"), text("lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n", F.col("body"), "packages:\n", F.col("stored")))
    return views.dependencies(found(files, "js-pnpm-lock")).select("path", F.col("pos").cast("long").alias("pos"), "raw", "section", F.col("extras")["specifier"].alias("specifier"))


@query("select 'p/' || page_id || '.html' as path, 'https://cdn.org/' || page_id || '.js' as raw from pages")
def html_scripts_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    body = text(F.coalesce("html", F.lit("")), "<script src='https://cdn.org/", F.col("page_id"), ".js'></script>")
    return listed(files_from_table(pages, text("p/", F.col("page_id"), ".html"), body), "html-external-scripts", fields=("raw",)).select("path", "raw")


@query("""
select 'p/' || page_id || '.html' as path, 'https://cdn.org/' || page_id || '/' || m || '.js' as raw from pages, (select unnest(['a', 'b']) as m) where page_id % 4 < 3
""")
def import_maps_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import maps are known by their type in any case; one of another type has no imports."""
    n = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("importmap", "IMPORTMAP", "ImportMap", "speculationrules"))), (n % 4 + 1).cast("int"))
    body = text("<script TYPE='", kind, '\'>{"imports": {"a": "https://cdn.org/', n, '/a.js", "b": "https://cdn.org/', n, '/b.js", "c": "./local.js"}}</script>')
    return views.dependencies(found(files_from_table(table(spark, sf_dir, "pages"), text("p/", n, ".html"), body), "html-external-scripts")).select("path", "raw")


@query("select 'w/' || s_nationkey || '/' || s_suppkey || '/go.sum' as path, 'go-sum' as type from supplier where s_suppkey % 3 > 0")
def backslash_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backslashes in paths are slashes, also where ignored folders are looked for."""
    s = table(spark, sf_dir, "supplier")
    path = text("w\\", F.when(F.col("s_suppkey") % 3 == 0, text("vendor\\", F.col("s_nationkey"))).otherwise(F.col("s_nationkey").cast("string")), "\\", F.col("s_suppkey"), "\\go.sum")
    files = s.select(F.lit("").alias("root"), path.alias("path"), F.lit("").cast("binary").alias("content"))
    return found(files, "go-sum").select("path", "type")


@query("select 'c' || c_custkey as root, 'go-sum' as type from customer where c_custkey % 3 = 0")
def names_without_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name without a path: only rules without a reader answer, whatever the content."""
    n = F.col("c_custkey")
    name = F.element_at(F.array(F.lit("go.sum"), F.lit("package.json"), F.lit("go.mod")), (n % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "customer").select(text("c", n).alias("root"), F.lit("").alias("path"), name.alias("name"), F.lit("module m\n").cast("binary").alias("content"))
    return found(files, "go-sum", "js", "go-mod").select("root", "type")


@query("select 'x/' || p_partkey || '/pom.xml' as path, p_size > 25 as has_dependencies from part")
def xml_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies at their place, with and without a namespace, also where the text breaks off behind them; elsewhere they do not count."""
    n, some = F.col("p_partkey"), F.col("p_size") > 25
    head = F.when(n % 2 == 0, '<m:project xmlns:m="u">').otherwise("<project>")
    inner = text("<dependencies>", F.when(n % 2 == 0, "<!-- none -->").otherwise(""), "<dependency><a>", F.col("p_brand"), "</a></dependency>")
    close = F.when(n % 2 == 0, "</m:project>").otherwise("</project>")
    body = text(head, "<name>", F.col("p_size"), "</name>", F.when(some, inner).otherwise(text("<build>", inner, "</dependencies></build>", close)), F.when(some & (n % 3 > 0), text("</dependencies>", close)).otherwise(""))
    return found(files_from_table(table(spark, sf_dir, "part"), text("x/", n, "/pom.xml"), body), "java").select("path", "has_dependencies")


@query("""
select 'i/' || s_nationkey || '/setup.cfg' as path, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as pos, 's' || s_suppkey || '>=' || (s_suppkey % 7) as raw from supplier
""")
def ini_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented items of a key, whatever the case of section and key, between other keys and comments."""
    n = F.col("s_nationkey")
    rows = gathered(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], text("  s", F.col("s_suppkey"), ">=", F.col("s_suppkey") % 7, "\n"), "")
    body = text("; note\n[metadata]\nname = x", n, "\n\n", F.when(n % 2 == 0, "[options]\ninstall_requires =\n").otherwise("[Options]\nzip_safe: false\nInstall_Requires =\n"), F.col("body"), "# end\n[other]\ninstall_requires = no\n")
    return listed(files_from_table(rows, text("i/", n, "/setup.cfg"), body), "python-setup-cfg", fields=("raw",))


EXISTS_RULE = "rules: [{name: piped, filename-regex: '[.]pipe$', yaml: {exists: 'stages[].image.tag'}}]"


@query("select 'y/' || c_custkey || '.pipe' as path, cast(null as boolean) as has_dependencies from customer where c_custkey % 3 = 0 or c_nationkey > 20")
def yaml_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that must lead to a node, through items of lists; what is there may be null."""
    n = F.col("c_custkey")
    first = F.when(n % 3 == 0, text("- image: {tag: ", F.when(n % 2 == 0, "null").otherwise(F.col("c_nationkey").cast("string")), "}\n")).otherwise("- image: {name: a}\n")
    second = F.when(F.col("c_nationkey") > 20, "- image:\n    tag: [1]\n").otherwise("- image: [tag]\n- tag: 1\n")
    return detect(files_from_table(table(spark, sf_dir, "customer"), text("y/", n, ".pipe"), text("name: p", n, "\nstages:\n", first, second)), parse_rules(EXISTS_RULE)).select("path", "has_dependencies")


@query("select page_id, cast(len(regexp_extract_all(html, '(?is)<script\\b([^>]*)>(.*?)</script>')) as bigint) as blocks from pages")
def html_script_blocks_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(script_blocks(F.col("html"))).cast("long").alias("blocks"))


@query("select 'j/' || p_partkey || '.js' as path, 'js-banner-block-start' as type, 'part-' || p_partkey || '@1.2.' || p_size as raw from part")
def banner_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_from_table(table(spark, sf_dir, "part"), text("j/", F.col("p_partkey"), ".js"), text("/*! part-", F.col("p_partkey"), " v1.2.", F.col("p_size"), " | x */\n", F.repeat(F.lit("x"), 5000)))
    got = detect(files, builtin_rules().only("js-banner-block-start", "js-banner-plain-block-start"))
    return views.dependencies(got).select("path", "type", "raw")


@query("""
select doc_id, cast(i - 1 as bigint) as line, nullif(regexp_extract(spec, '^([A-Za-z0-9._-]*)', 1), '') as name
from (select doc_id, unnest(string_split(text, chr(10))) as spec, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)
""")
def pep508_name_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "spec"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), pep508(F.col("spec"))[0].alias("name"))


@query("select 'e/' || event_id || '/package.json' as path, (event_id % 3 = 0 or len(json_keys(props)) = 0) is not true as has_dependencies from events")
def json_exists_any_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text('{"dependencies": ', F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.col("props")), "}")
    return found(files_from_table(table(spark, sf_dir, "events"), text("e/", F.col("event_id"), "/package.json"), body), "js").select("path", "has_dependencies")


#: Ten kinds of files by key modulo ten: path, content, and what they must give.
MIXED = (
    ("Cargo.toml", '[dependencies]\na = "1"\n'), ("Cargo.toml", "[dependencies]\n"), ("Chart.yaml", "dependencies: [a]\n"), ("environment.yml", "dependencies: []\n"), ("pom.xml", "<project><dependencies><dependency/></dependencies></project>"),
    ("setup.cfg", "[options]\ninstall_requires =\n  a>=1\n  b\n"), ("main.tf", 'resource "aws_glue_job" "x" {\n  default_arguments = {\n    "--job-language" = "python"\n    "--additional-python-modules" = "a"\n  }\n}\n'),
    ("job.ts", 'import * as g from "aws-cdk-lib/aws-glue";\nnew g.CfnJob(this, "x", { defaultArguments: { "--job-language": "python", "--additional-python-modules": "a, b" } });\n'),
    ("setup.py", "from setuptools import setup\nsetup(install_requires=['a', 'b', 'c'])\n"), ("node_modules/package.json", "{}"),
)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 10
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in MIXED]), (m + 1).cast("int"))
    files = files_from_table(table(spark, sf_dir, "orders"), text("m/", F.col("o_orderkey"), "/", at(0)), at(1))
    kinds = ("rust-cargo", "helm-chart", "python-conda-environment", "java", "python-setup-cfg", "terraform.aws_glue_job.python", "typescript.cdk.aws_glue_job.python", "python-setup-py", "python.cdk.aws_glue_job.python", "js")
    return detect(files, builtin_rules().only(*kinds))


MIXED_SQL = """
with m as (
  select o_orderkey as k, ['Cargo.toml', 'Cargo.toml', 'Chart.yaml', 'environment.yml', 'pom.xml', 'setup.cfg', 'main.tf', 'job.ts', 'setup.py'][o_orderkey % 10 + 1] as file,
    ['rust-cargo', 'rust-cargo', 'helm-chart', 'python-conda-environment', 'java', 'python-setup-cfg', 'terraform.aws_glue_job.python', 'typescript.cdk.aws_glue_job.python', 'python-setup-py'][o_orderkey % 10 + 1] as type,
    [true, false, true, null, true, true, null, true, true][o_orderkey % 10 + 1] as has_dependencies, [0, 0, 0, 0, 0, 2, 0, 2, 3][o_orderkey % 10 + 1] as deps
  from orders where o_orderkey % 10 < 9
)
"""


@query(MIXED_SQL + "select 'm/' || k || '/' || file as path, type, has_dependencies, cast(deps as bigint) as deps from m")
def first_match_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors, ignored folders, presence checks, INI, Terraform, TypeScript and Python readers, first match."""
    return _mixed(spark, sf_dir).select("path", "type", "has_dependencies", F.coalesce(F.size("dependencies"), F.lit(0)).cast("long").alias("deps"))


@query(MIXED_SQL + "select case when deps > 0 then 'extracted' when has_dependencies is null then 'unknown' when has_dependencies then 'present-not-extracted' else 'empty' end as status, count(*) as manifests from m group by 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(_mixed(spark, sf_dir)).select("status", "manifests")


@query("select 'v/' || c_custkey || '/' || ['src', 'vendor', 'node_modules'][c_custkey % 3 + 1] || '/go.sum' as path from customer where c_custkey % 3 = 0")
def ignored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(F.lit("src"), F.lit("vendor"), F.lit("node_modules")), (F.col("c_custkey") % 3 + 1).cast("int"))
    path = text("v/", F.col("c_custkey"), "/", folder, "/go.sum")
    return files_from_table(table(spark, sf_dir, "customer"), path, F.lit("")).where(not_ignored(F.col("path"))).select("path")


@query("""
select 'n/' || s_nationkey || '/pyproject.toml' as path, case when s_suppkey % 2 = 0 then 'project.dependencies' else 'project.optional-dependencies.dev' end as section,
  cast(count(*) as bigint) as deps, min('s' || s_suppkey || '>=1') as first from supplier group by 1, 2
""")
def toml_path_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path queries over TOML, grouped by section."""
    s = table(spark, sf_dir, "supplier")
    lines = lambda part, name: gathered(s.where(part), "s_nationkey", ["s_suppkey"], text('"s', F.col("s_suppkey"), '>=1"'), ", ").withColumnRenamed("body", name)
    rows = lines("s_suppkey % 2 = 0", "even").join(lines("s_suppkey % 2 = 1", "odd"), "s_nationkey", "full")
    body = text("[project]\ndependencies = [", F.coalesce("even", F.lit("")), "]\n[project.optional-dependencies]\ndev = [", F.coalesce("odd", F.lit("")), "]\n")
    got = views.sections(found(files_from_table(rows, text("n/", F.col("s_nationkey"), "/pyproject.toml"), body), "python-pyproject"))
    return got.select("path", "section", F.size("displays").cast("long").alias("deps"), F.array_min("displays").alias("first"))


YAML_RULE = "rules: [{name: steps, filename-regex: '\\.flow$', yaml: {query: 'jobs[].image'}}]"


@query("select 'p/' || p_partkey || '.flow' as path, unnest(['img-' || p_brand, 'img-' || p_size || '-x']) as raw from part")
def yaml_path_custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text("jobs:\n- image: img-", F.col("p_brand"), "\n- image: img-", F.col("p_size"), "-x\n- other: 1\n")
    files = files_from_table(table(spark, sf_dir, "part"), text("p/", F.col("p_partkey"), ".flow"), body)
    return views.dependencies(detect(files, parse_rules(YAML_RULE))).select("path", "raw")


@query("select 'part-' || l_partkey as name, count(distinct l_orderkey) as manifests, count(*) as uses, cast(0 as bigint) as versions from lineitem group by 1")
def package_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text("part-", F.col("l_partkey"), "==", F.col("l_linenumber"))
    rows = gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], line)
    return views.package_usage(found(files_from_table(rows, text("orders/", F.col("l_orderkey"), "/requirements.txt"), F.col("body")), "python-requirements"))


#: Files that a name alone recognises, and one that only a reader can.
NAMES = (("bun.lock", "js-bun-lock"), ("Gemfile", "ruby-gemfile"), ("go.sum", "go-sum"), ("Package.swift", "swift-package"), ("build.gradle.kts", "java-gradle-kts"), ("stack.yaml.lock", "haskell-stack-lock"), ("paket.lock", "dotnet-paket-lock"), ("go.mod", None))


def _by_key(key: str, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


NAMES_SQL = """
with n as (select c_custkey as k, {names}[c_custkey % 8 + 1] as name, {types}[c_custkey % 8 + 1] as type from customer)
""".replace("{names}", str([n for n, _ in NAMES])).replace("{types}", str([t for _, t in NAMES]).replace("None", "null"))


@query(NAMES_SQL + "select k as c_custkey, name, type from n")
def selector_only_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of bare names, without files."""
    names = table(spark, sf_dir, "customer").select("c_custkey", _by_key("c_custkey", [n for n, _ in NAMES]).alias("name"))
    return names.withColumn("type", selector_type(builtin_rules(), F.col("name")))


@query(NAMES_SQL + "select 'c/' || k || '/' || name as path, coalesce(type, 'go-mod') as type, case when type is null then 'empty' else 'unknown' end as status from n")
def selector_only_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules over files that mostly need no reader."""
    files = files_from_table(table(spark, sf_dir, "customer"), text("c/", F.col("c_custkey"), "/", _by_key("c_custkey", [n for n, _ in NAMES])), F.lit("module m\n"))
    return detect(files, builtin_rules().only(*(t for _, t in NAMES if t), "go-mod")).select("path", "type", views.status().alias("status"))


GLOB_RULES = r"""
rules:
  - {name: both, path-glob: 'src/**/y?.[a-c]', filename-regex: '^y[0-4]'}
  - {name: glob, path-glob: 'src/**/y?.[a-c]'}
  - {name: name, filename-regex: '[.]d$'}
"""


@query("""
with p as (select p_partkey as k, ['src', 'src/x', 'src/x/z', 'lib'][p_partkey % 4 + 1] || '/' || p_partkey || '/y' || (p_partkey % 10) || '.' || ['a', 'b', 'd'][p_partkey % 3 + 1] as path from part)
select path, case when k % 3 = 2 then 'name' when k % 10 <= 4 then 'both' else 'glob' end as type from p where k % 3 = 2 or k % 4 < 3
""")
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path globs, and selectors of which both must hold."""
    key = F.col("p_partkey")
    path = text(_by_key("p_partkey", ["src", "src/x", "src/x/z", "lib"]), "/", key, "/y", key % 10, ".", _by_key("p_partkey", ["a", "b", "d"]))
    return detect(files_from_table(table(spark, sf_dir, "part"), path, F.lit("")), parse_rules(GLOB_RULES)).select("path", "type")


@query("""
select 'n/' || s_nationkey || '/Pipfile' as path, row_number() over (partition by s_nationkey order by s_suppkey % 2, 's' || s_suppkey) - 1 as pos,
  's' || s_suppkey || case when s_suppkey % 2 = 0 then ' = "*"' else ' = { extras = ["x"], version = "==' || (s_suppkey % 7) || '" }' end as raw,
  case when s_suppkey % 2 = 0 then 'packages' else 'dev-packages' end as section from supplier
""")
def toml_table_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a Pipfile: keys with their values on one line, packages first, excluded tables left out."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    value = F.when(key % 2 == 0, '"*"').otherwise(text('{ version = "==', key % 7, '", extras = ["x"] }'))
    lines = lambda part, name: gathered(s.where(part), "s_nationkey", ["s_suppkey"], text("s", key, " = ", value)).withColumnRenamed("body", name)
    rows = lines("s_suppkey % 2 = 0", "even").join(lines("s_suppkey % 2 = 1", "odd"), "s_nationkey", "full")
    body = text('[[source]]\nurl = "u"\n[dev-packages]\n', F.coalesce("odd", F.lit("")), "\n[packages]\n", F.coalesce("even", F.lit("")), '\n[requires]\npython_version = "3"\n')
    return listed(files_from_table(rows, text("n/", F.col("s_nationkey"), "/Pipfile"), body), "python-pipfile", fields=("raw", "section"))


@query("""
select distinct 'n/' || s_nationkey || '/package-lock.json' as path, unnest(['s' || s_suppkey || '@' || (s_suppkey % 7), 'in-' || (s_suppkey % 5) || '@9']) as raw from supplier
""")
def npm_version_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested dependencies of the first format; a name and version that come again count once."""
    key = F.col("s_suppkey")
    body = _json_map(spark, sf_dir, text("s", key), text('{"version": "', key % 7, '", "dependencies": {"in-', key % 5, '": {"version": "9"}}}'))
    files = files_from_table(body, text("n/", F.col("s_nationkey"), "/package-lock.json"), text('{"lockfileVersion": 1, "dependencies": {', F.col("body"), "}}"))
    return views.dependencies(found(files, "js-npm-lock")).select("path", "raw")


@query("""
select 'n/' || s_nationkey || '/package-lock.json' as path, row_number() over (partition by s_nationkey order by s_suppkey % 2, 's' || s_suppkey) - 1 as pos, 's' || s_suppkey as raw,
  case when s_suppkey % 2 = 0 then 'dependencies' else 'devDependencies' end as section from supplier
""")
def npm_root_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock that holds nothing but its root: the root's maps are the dependencies."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    entry = lambda part, name: gathered(s.where(part), "s_nationkey", ["s_suppkey"], text('"s', key, '": "*"'), ", ").withColumnRenamed("body", name)
    rows = entry("s_suppkey % 2 = 0", "even").join(entry("s_suppkey % 2 = 1", "odd"), "s_nationkey", "full")
    body = text('{"lockfileVersion": 3, "packages": {"": {"dependencies": {', F.coalesce("even", F.lit("")), '}, "devDependencies": {', F.coalesce("odd", F.lit("")), "}}}}")
    return listed(files_from_table(rows, text("n/", F.col("s_nationkey"), "/package-lock.json"), body), "js-npm-lock", fields=("raw", "section"))


@query("""
select 'j/' || p_partkey || '.py' as path, unnest(['part-' || p_partkey || '==' || p_size, 'numpy']) as raw from part where p_partkey % 3 > 0
""")
def python_cdk_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A construct whose argument is a constant that is assigned before, twice: the last assignment before the call counts."""
    key = F.col("p_partkey")
    body = text(
        'from aws_cdk import aws_glue as glue\nMODS = "old"\nMODS = "part-', key, "==", F.col("p_size"), ',numpy"\nargs = {"--job-language": "', F.when(key % 3 > 0, "python").otherwise("scala"),
        '", "--additional-python-modules": MODS}\nglue.CfnJob(self, "x", default_arguments=args)\nMODS = "late"\n',
    )
    files = files_from_table(table(spark, sf_dir, "part"), text("j/", key, ".py"), body)
    return views.dependencies(found(files, "python.cdk.aws_glue_job.python")).select("path", "raw")


@query("""
select 't/' || p_partkey || '/main.tf' as path, cast(null as boolean) as has_dependencies from part
where case p_partkey % 6 when 0 then p_size > 25 when 1 then p_size % 2 = 0 when 2 then p_brand < 'Brand#3' when 3 then p_size + 3 * 2 = 20 when 4 then p_type like 'S%' else false end
""")
def terraform_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose language is a constant expression over a part's values: conditional, index, comparison of strings by a for, arithmetic, template; a variable is none."""
    n, size = F.col("p_partkey"), F.col("p_size")
    language = (
        F.when(n % 6 == 0, text(size, ' > 25 ? "python" : "scala"')).when(n % 6 == 1, text('["python", "scala"][', size, " % 2]"))
        .when(n % 6 == 2, text('[for b in ["', F.col("p_brand"), '"] : b == "', F.when(F.col("p_brand") < "Brand#3", F.col("p_brand")).otherwise("none"), '" ? "python" : "other"][0]'))
        .when(n % 6 == 3, text("(", size, ' + 3 * 2 == 20 && true) ? "python" : null')).when(n % 6 == 4, text('"${ {S = "pyth", } [ "', F.substring("p_type", 1, 1), '" ] }on"')).otherwise(F.lit("var.language"))
    )
    body = text('variable "language" {}\nresource "aws_glue_job" "j" {\n  default_arguments = {\n    "--job-language" = ', language, '\n    "--additional-python-modules" = "part-${', n, ' + 0}"\n    n = 1 + 2\n  }\n}\n')
    return found(files_from_table(table(spark, sf_dir, "part"), text("t/", n, "/main.tf"), body), "terraform.aws_glue_job.python").select("path", "has_dependencies")


@query("""
select 's/' || s_suppkey || '.ts' as path, unnest(['supplier-' || s_suppkey, 'nation-' || s_nationkey]) as raw from supplier where s_suppkey % 6 in (0, 1, 4)
""")
def typescript_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, a name of one and a name of a string fit; an object with `as`, in brackets or by a spread does not."""
    n = F.col("s_suppkey")
    args = text('{ "--job-language": "python", "--additional-python-modules": "supplier-', n, ",nation-", F.col("s_nationkey"), '" }')
    one = lambda s: text('new glue.CfnJob(this, "x", ', s, ");\n")
    body = F.concat(F.lit('import * as glue from "aws-cdk-lib/aws-glue";\n'), (
        F.when(n % 6 == 0, one(text("{ defaultArguments: ", args, " }"))).when(n % 6 == 1, text("const p: P<A, B> = { defaultArguments: ", args, " }\n", one("p")))
        .when(n % 6 == 2, text("const p = { defaultArguments: ", args, " } as const;\n", one("p"))).when(n % 6 == 3, one(text("({ defaultArguments: ", args, " })")))
        .when(n % 6 == 4, text('const m = "supplier-', n, ", nation-", F.col("s_nationkey"), '"\n', one('{ defaultArguments: { "--job-language": "python", "--additional-python-modules": m } }')))
        .otherwise(text("const p = { defaultArguments: ", args, " }\n", one("{ ...p }")))
    ))
    return views.dependencies(found(files_from_table(table(spark, sf_dir, "supplier"), text("s/", n, ".ts"), body), "typescript.cdk.aws_glue_job.python")).select("path", "raw")


@query("""
select 'n/' || c_custkey || '.py' as path, 'nation-' || c_nationkey as raw from customer where c_custkey % 4 < 2
""")
def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of keys and of names lead to the last assignment before the call; keyword arguments and sums assign nothing."""
    n = F.col("c_custkey")
    first = F.when(n % 4 == 0, text('K = "--job-language"\nL = M\nM = "python"\n')).when(n % 4 == 1, text('K = "--job-language"\nL = "python"\nrun(L="scala")\n')).when(n % 4 == 2, text('K = "--job-language"\nL = "python"\nL = L + ""\n')).otherwise(text('K = "--other"\nL = "python"\n'))
    body = F.concat(F.lit("from aws_cdk import aws_glue\n"), first, text('args = {K: L, "--additional-python-modules": "nation-', F.col("c_nationkey"), '"}\naws_glue.CfnJob(self, "x", default_arguments=args)\n'))
    return views.dependencies(found(files_from_table(table(spark, sf_dir, "customer"), text("n/", n, ".py"), body), "python.cdk.aws_glue_job.python")).select("path", "raw")


@query("""
select 'c/' || c_custkey || '/setup.py' as path, unnest(['own-' || c_custkey, 'nation-' || c_nationkey]) as raw from customer
""")
def setup_py_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's arguments; what is listed again counts once."""
    key = F.col("c_custkey")
    body = text("from setuptools import setup\nsetup(install_requires=['own-", key, "', 'nation-", F.col("c_nationkey"), "', 'own-", key, "'])\n")
    return views.dependencies(found(files_from_table(table(spark, sf_dir, "customer"), text("c/", key, "/setup.py"), body), "python-setup-py")).select("path", "raw")


@query("""
select 'c/' || c_custkey || '/requirements.txt' as path, cast(i as bigint) as pos, case i when 0 then 'own-' || c_custkey || ' >=1' else 'nation-' || c_nationkey || '[x]==2 ; a' end as raw,
  case i when 0 then 'own-' || c_custkey else 'nation-' || c_nationkey end as name, case i when 0 then '>=1' else '[x]==2 ; a' end as "constraint"
from customer, (select unnest([0, 1]) as i)
""")
def requirements_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go on after a backslash, options, comments and blank lines."""
    body = text("--index-url https://x\n\n# note\nown-", F.col("c_custkey"), " \\\n   >=1\n-c other.txt\n  nation-", F.col("c_nationkey"), "[x]==2 ; a\n--hash=sha256:1\n")
    return listed(files_from_table(table(spark, sf_dir, "customer"), text("c/", F.col("c_custkey"), "/requirements.txt"), body), "python-requirements", fields=("raw", "name", "constraint"))


@query("""
select 'c/' || c_custkey || '/requirements.txt' as path, c_custkey % 2 = 0 as has_dependencies, unnest([
  'detected requirements include cycle for "/c/' || c_custkey || '/requirements.txt" via "requirements.txt"',
  'could not read included requirements file "gone.txt": open /c/' || c_custkey || '/gone.txt: no such file or directory']) as warning
from customer
""")
def requirements_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes that lead to themselves or to nothing; without dependencies they leave the status unknown."""
    body = text("-r requirements.txt\n-r gone.txt\n", F.when(F.col("c_custkey") % 2 == 0, "a\n").otherwise(""))
    got = found(files_from_table(table(spark, sf_dir, "customer"), text("c/", F.col("c_custkey"), "/requirements.txt"), body), "python-requirements")
    return got.select("path", F.coalesce("has_dependencies", F.lit(False)).alias("has_dependencies"), F.explode("warnings").alias("warning"))


def _go_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of go.mod files with none, one, or two requirements, one of them indirect."""
    key = F.col("c_custkey")
    lines = F.when(key % 3 == 0, "").when(key % 3 == 1, text("require a.b/c", key, " v1.0.0\n")).otherwise(text("require (\n\ta.b/c", key, " v1.0.0\n\td.e/f v2.1.0 // indirect\n)\n"))
    return found(files_from_table(table(spark, sf_dir, "customer"), text("c/", key, "/go.mod"), text("module m\n\ngo 1.22\n\n", lines)), "go-mod")


BLOCK_SQL = """
select 'c/' || c_custkey || '/go.mod' as path, chr(10) || 'c/' || c_custkey || '/go.mod ' || case c_custkey % 3
  when 0 then '[no dependencies]' || chr(10) when 1 then '[1 dep]' || chr(10) || '  - a.b/c' || c_custkey || '@v1.0.0' || chr(10)
  else '[2 deps]' || chr(10) || '  [default group]' || chr(10) || '    - a.b/c' || c_custkey || '@v1.0.0' || chr(10) || '  indirect:' || chr(10) || '    - d.e/f@v2.1.0' || chr(10) end as block
from customer
"""


@query(BLOCK_SQL + " where c_custkey % 3 > 0")
def text_report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report's block per manifest with its label and sections; manifests without dependencies are hidden."""
    return rendered(views.visible(_go_mods(spark, sf_dir))).select("path", "block")


@query(BLOCK_SQL)
def text_report_show_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(views.visible(_go_mods(spark, sf_dir), show_empty=True)).select("path", "block")


@query("select 'c/' || c_custkey || '/go.mod' as path, 'go-mod' as type, c_custkey % 3 > 0 as has_dependencies, cast(c_custkey % 3 as bigint) as deps from customer")
def json_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed JSON report, written and read again."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_json(_go_mods(spark, sf_dir), path)
    back = spark.read.schema("path string, type string, has_dependencies boolean, dependencies array<struct<name: string>>").json(path)
    return back.select("path", "type", "has_dependencies", F.coalesce(F.size("dependencies"), F.lit(0)).cast("long").alias("deps"))


@query("""
select 'c/' || c_custkey || '/go.mod' as path, case when c_custkey % 3 = 0 then 'empty' else 'unknown' end as status,
  [null, 'unknown directive: bogus', 'unknown block type: things'][c_custkey % 3 + 1] as warning from customer
""")
def go_mod_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be read, kept as manifests of unknown status with a warning."""
    body = text("module m\n", _by_key("c_custkey", ["", "bogus y\n", "things (\n\tx\n)\n"]))
    got = detect(files_from_table(table(spark, sf_dir, "customer"), text("c/", F.col("c_custkey"), "/go.mod"), body), builtin_rules().only("go-mod"), on_error="warn")
    return got.select("path", views.status().alias("status"), F.get("warnings", F.lit(0)).alias("warning"))


TOML_RULE = "rules: [{name: any, filename-regex: '[.]toml$', toml: {exists-any: ['x.*.y'], table-exists-any: [q]}}, {name: tables, filename-regex: '[.]tml$', toml: {table-exists-any: ['t.*']}}]"


@query("""
select 'p/' || p_partkey || case when p_partkey % 2 = 0 then '.toml' else '.tml' end as path, case when p_partkey % 2 = 0 then 'any' else 'tables' end as type,
  case when p_partkey % 2 = 0 then p_partkey % 4 = 0 else p_partkey % 3 = 0 end as has_dependencies from part
""")
def toml_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and tables that paths with wildcards reach; empty ones do not count."""
    key = F.col("p_partkey")
    even = text("[x.k", key, "]\ny = ", F.when(key % 4 == 0, "0").otherwise('""'), "\n[q]\nr = 1\n")
    odd = text("[t.k", key, "]\n", F.when(key % 3 == 0, "z = 1\n").otherwise(""))
    files = files_from_table(table(spark, sf_dir, "part"), text("p/", key, F.when(key % 2 == 0, ".toml").otherwise(".tml")), F.when(key % 2 == 0, even).otherwise(odd))
    return detect(files, parse_rules(TOML_RULE)).select("path", "type", "has_dependencies")


@query("""
select distinct 'n/' || s_nationkey || '/poetry.lock' as path, 's' || (s_suppkey % 4) || '==' || (s_suppkey % 3) as raw from supplier
""")
def poetry_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that a lock lists more than once."""
    key = F.col("s_suppkey")
    rows = gathered(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey"], text('[[package]]\nname = "s', key % 4, '"\nversion = "', key % 3, '"\n'))
    return views.dependencies(found(files_from_table(rows, text("n/", F.col("s_nationkey"), "/poetry.lock"), F.col("body")), "python-poetry-lock")).select("path", "raw")
