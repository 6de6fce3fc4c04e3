"""The tables of the library.

FILES: one row per file of a tree; LISTING is that without contents. Tables that readers return are keyed by file and rule: FOUND says whether a rule
matched, DEPS has a row per dependency with its place in `seat`, NOTES a row per warning. MANIFESTS has one row per recognised file.
"""

LISTING = "root string, path string, name string"
FILES = "root string, path string, name string, content binary"
DEP_FIELDS = ("raw", "name", "version", "constraint", "section", "source", "extras")
DEPENDENCY = "struct<raw:string,name:string,version:string,constraint:string,section:string,source:string,extras:map<string,string>>"
MANIFESTS = f"root string, path string, type string, dependencies array<{DEPENDENCY}>, has_dependencies boolean, warnings array<string>"

FILE = ["root", "path"]
KEY = ["root", "path", "ordinal"]
#: matched: null means "only with dependencies"; absent: has_dependencies of a match without dependencies.
FOUND = "root string, path string, ordinal int, matched boolean, absent boolean, error string"
DEPS = "root string, path string, ordinal int, seat string, raw string, name string, version string, constraint string, section string, source string, extras map<string,string>"
NOTES = "root string, path string, ordinal int, seat string, warning string"
