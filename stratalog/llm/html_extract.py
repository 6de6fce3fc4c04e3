"""Main text of pages by templates that are deduced per host from equivalence classes of tokens.

Tokens are container tags and words, each in the context of its container. A token's occurrence vector is its count on
each distinct page of the host; two sums of seeded page hashes stand for the vector, so equal vectors meet in a
grouping and no host is ever gathered. Tokens of equal vectors are a class; classes that are on nearly every page,
large enough, in one order and within one gap of the root class are nested into the host's template. Containers whose
text is template words are constant, and so are whole short runs of words between two tags that recur in one container; what remains are slots. Labels that few of a host's pages
have (classes made anew for each page) do not tell containers apart. The article's slot is the innermost template container that
holds the host's remaining text and its title; each page gives the blocks that are left in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, text_slices, word_hashes, written
from .markup import CLEAN, STRONG, Block, read_page

#: Share of a host's distinct pages on which a template token must be, and share of the host's slot text that the article's slot holds.
SUPPORT, HOLDS = 0.8, 0.8
#: Distinct pages from which a host has a template, tokens from which a class other than the root's counts, share of template
#: words from which a container is constant, and share of the host's text that constant containers may take.
LEAST_PAGES, LEAST_CLASS, CONSTANT, MOST_CONSTANT = 8, 3, 0.8, 0.5
#: Words of a run between two tags that is template text on its own, at most: longer constant runs in the article's container are taken for its text. Share of a
#: host's distinct pages that must have a container's label, or it counts for nothing.
MOST_RUN, KNOWN = 12, 0.2
#: Rows that are broadcast to pages; beyond, pages are shuffled by host.
MOST_BROADCAST = 200_000
#: Tokens that a task holds before it hands on those that are on at least half of its pages of a host.
HELD = 2_000_000

PARSED = "rid long, key long, url string, host string, page long, lines array<string>, paths array<string>, marks array<int>, opens array<string>, starts array<int>"
STATS = "host string, token long, path string, word boolean, pages long, total long, least long, most long, v1 long, v2 long, chars long"


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def clean_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks outside boilerplate by names; where all are marked, those marked by words only, or else all of the body."""
    for most in (CLEAN, STRONG - 1):
        if kept := [b for b in blocks if b.boiler <= most]:
            return kept
    return [b for b in blocks if not b.path.startswith("/html/head")]


def parsed_pages(rows: DataFrame) -> DataFrame:
    """rows (key, url, host, html) with their blocks and tags in place of html; rid numbers the rows."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list = [[] for _ in range(7)]
            for source in batch.column(3).to_pylist():
                source = source or ""
                page = read_page(source)
                digest = hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                row = (rid, int.from_bytes(digest, "little", signed=True), [b.text for b in page.blocks], [b.path for b in page.blocks], [b.boiler for b in page.blocks], ["", *(p for p, _ in page.opens)], [0, *(n for _, n in page.opens)])
                rid += 1
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([made[0], *(batch.column(i) for i in range(3)), *made[1:]], ["rid", "key", "url", "host", "page", "lines", "paths", "marks", "opens", "starts"])

    return rows.select("key", "url", "host", "html").mapInArrow(run, PARSED)


class Tokens(NamedTuple):
    """Tokens of some rows, in page order: key (of host, context and tag or word), row, path number, whether a word; and
    per block its row, path number, words and characters outside boilerplate."""

    first: int
    rows: int
    key: np.ndarray
    row: np.ndarray
    path: np.ndarray
    word: np.ndarray
    paths: list[str]
    block_row: np.ndarray
    block_path: np.ndarray
    block_words: np.ndarray
    block_chars: np.ndarray


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _list(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets.astype(np.int64) - offsets[0]


def tokens_of(batch: pa.RecordBatch) -> Iterator[Tokens]:
    """Tokens of the rows of a batch (host, lines, paths, marks, opens, starts by name), some rows at a time."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    size = pc.list_parent_indices(column("lines"))
    weight = np.bincount(size.to_numpy(), weights=pc.binary_length(column("lines").flatten()).to_numpy(zero_copy_only=False), minlength=batch.num_rows) if len(size) else np.zeros(batch.num_rows)
    cut = np.flatnonzero(np.diff(np.floor(np.cumsum(weight) / SLICE_BYTES))) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        if a == b:
            continue
        part = lambda c, a=a, b=b: column(c).slice(a, b - a)
        (lines, edges), (paths, _), (marks, _), (opens, open_edges), (starts, _) = (_list(part(c)) for c in ("lines", "paths", "marks", "opens", "starts"))
        names = pa.chunked_array([paths, opens], pa.string()).combine_chunks().dictionary_encode()
        code, known = names.indices.to_numpy().astype(np.int64), names.dictionary.to_pylist()
        at = np.array([_hash(p) for p in known], np.uint64)
        host = np.array([_hash(h) for h in part("host").to_pylist()], np.uint64)
        h, first = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        for _, _, data, offsets in text_slices(lines, 1 << 62):
            h, first = word_hashes(data, offsets)
        block_row = np.repeat(np.arange(b - a), np.diff(edges))
        words = np.diff(first)
        block_path, open_path = code[: len(lines)], code[len(lines) :]
        row = np.repeat(block_row, words)
        path = np.repeat(block_path, words)
        open_row = np.repeat(np.arange(b - a), np.diff(open_edges))
        place = first[np.minimum(edges[open_row] + starts.to_numpy().astype(np.int64), len(lines))]
        # a tag stands before the word that follows it; the sort is stable
        order = np.argsort(np.r_[2 * place, 2 * np.arange(len(h)) + 1], kind="stable")
        key = np.r_[mix(mix(at[open_path] + np.uint64(1)) ^ host[open_row]), mix(mix(h ^ at[path]) ^ host[row])]
        clean = (marks.to_numpy() == CLEAN) * pc.utf8_length(lines).to_numpy(zero_copy_only=False)
        yield Tokens(a, b - a, key[order], np.r_[open_row, row][order], np.r_[open_path, path][order], (np.arange(len(key)) >= len(open_row))[order], known, block_row, block_path, words, clean.astype(np.int64))


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys are together, the first place of each group in it, and the groups' sizes."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(fresh)
    return order, first, np.diff(np.r_[first, len(order)])


def _near(big: DataFrame, small: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """big joined with small, which is broadcast if it has at most so many rows."""
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)


def distinct_pages(table: DataFrame, most: int) -> DataFrame:
    """The first row of each distinct page of each host: copies of a page are one piece of evidence."""
    copies = written(table.groupBy("host", "page").agg(F.min("rid").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    return _near(table, copies, ["host", "page"], "left", most).where("__first is null or __first = rid").drop("__first")


def _on_many(pages: DataFrame, each: F.Column, sizes: DataFrame, share: float, name: str) -> DataFrame:
    """(host, name: array): what of the array `each` is on at least `share` of a host's pages; as many as a few pages have at most."""
    count = pages.select("host", F.explode(F.array_distinct(each)).alias("x")).groupBy("host", "x").agg(F.count("*").alias("k"))
    return count.join(sizes, "host").where(F.col("k") >= share * F.col("n")).groupBy("host").agg(F.sort_array(F.collect_list("x")).alias(name))


def known_labels(pages: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """(host, known array<string>): the labelled containers that count."""
    last = F.transform("opens", lambda p: F.element_at(F.split(p, "/"), -1))
    return _on_many(pages, F.filter(last, lambda s: F.contains(s, F.lit("."))), sizes, share, "known")


def with_known(table: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """table whose paths have, on the hosts of known, only labels that are known there."""
    step = lambda s: F.when(~F.contains(s, F.lit(".")) | F.array_contains(F.coalesce("known", F.array().cast("array<string>")), s), s).otherwise(F.substring_index(s, ".", 1))
    plain = lambda c: F.when(F.col("some"), F.transform(c, lambda p: F.array_join(F.transform(F.split(p, "/"), step), "/"))).otherwise(F.col(c)).alias(c)
    rows = _near(table, known.withColumn("some", F.lit(True)), ["host"], "left", most)
    return rows.select(*[plain(c) if c in ("paths", "opens") else c for c in table.columns])


def _runs(words: int) -> F.Column:
    """Per block a hash of its container and text, null where it has more words."""
    return F.transform(F.arrays_zip("paths", "lines"), lambda b: F.when(F.size(F.split(b["lines"], " ")) <= words, F.xxhash64(b["paths"], b["lines"])))


def candidates(pages: DataFrame, support: float, held: int = HELD) -> DataFrame:
    """(host, tokens array<long>): all tokens that can be on `support` of a host's pages.

    A task hands on, with their counts, the tokens on at least half of its pages of a host; how often a token can have
    been left out is known, so none that belongs here is lost, and words of articles are mostly never shuffled."""

    def run(batches):
        hosts: dict[str, int] = {}
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        pages_of: list[int] = []

        def flush():
            key, owner, n = np.concatenate(keys), np.concatenate(owners), np.array(pages_of)
            order, first, count = _grouped(key)
            key, owner = key[order][first], owner[order][first]
            missed = (n + 1) // 2 - 1
            some = count > missed[owner]
            names = pa.array(list(hosts), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([names.take(pa.array(owner[some])), names]), pa.concat_arrays([pa.array(key[some].view(np.int64)), pa.nulls(len(n), pa.int64())]), pa.array(np.r_[count[some], n]), pa.array(np.r_[missed[owner[some]], missed])],
                ["host", "token", "n", "missed"],
            )
            hosts.clear()
            keys.clear()
            owners.clear()
            pages_of.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for t in tokens_of(batch):
                own = np.zeros(t.rows, np.int64)
                for i, name in enumerate(names[t.first : t.first + t.rows]):
                    own[i] = hosts.setdefault(name, len(hosts))
                    if own[i] == len(pages_of):
                        pages_of.append(0)
                    pages_of[own[i]] += 1
                order, first, _ = _grouped(t.row, t.key)
                keys.append(t.key[order][first])
                owners.append(own[t.row[order][first]])
                if sum(map(len, keys)) > held:
                    yield from flush()
        if keys:
            yield from flush()

    parts = pages.select("host", "lines", "paths", "marks", "opens", "starts").mapInArrow(run, "host string, token long, n long, missed long")
    found = written(parts.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed")))
    hosts = found.where("token is null").select("host", F.col("n").alias("pages"), F.col("missed").alias("all_missed"))
    kept = found.where("token is not null").join(hosts, "host").where(F.col("n") + F.col("all_missed") - F.col("missed") >= support * F.col("pages"))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def _of_hosts(batch: pa.RecordBatch, t: Tokens, name: str) -> tuple[list[str], np.ndarray, pa.Array]:
    """The hosts of some rows, each row's number among them, and the list column `name` once per host."""
    hosts = batch.column(0).slice(t.first, t.rows).dictionary_encode()
    own = hosts.indices.to_numpy().astype(np.int64)
    where = np.unique(own, return_index=True)[1]
    column = batch.column(batch.schema.get_field_index(name)).slice(t.first, t.rows)
    return hosts.dictionary.to_pylist(), own, column.take(pa.array(where)).flatten()


def occurrence_stats(pages: DataFrame) -> DataFrame:
    """Per host and candidate token of pages (with tokens): its context, whether a word, on how many pages it is, its count in all, least and
    most on one, and the two sums of its occurrence vector. Rows without a token are contexts, with all their words and
    their characters outside marked boilerplate."""

    def run(batches):
        for batch in batches:
            digest = mix(batch.column(batch.schema.get_field_index("page")).to_numpy().view(np.uint64))
            for t in tokens_of(batch):
                hosts, own, wanted = _of_hosts(batch, t, "tokens")
                wanted = np.sort(wanted.to_numpy().view(np.uint64))
                spot = np.searchsorted(wanted, t.key)
                spot[spot == len(wanted)] = 0
                member = np.flatnonzero(wanted[spot] == t.key) if len(wanted) else np.zeros(0, np.int64)
                spot, row = spot[member], t.row[member]
                order, first, count = _grouped(spot, row)
                spot, row, member = spot[order][first], row[order][first], member[order][first]
                edge = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, np.int64)
                add = lambda x, edge=edge: np.add.reduceat(x, edge) if len(edge) else np.zeros(0, np.int64)
                mark = digest[t.first + row]
                at = member[edge]
                of_block = np.lexsort((t.block_path, own[t.block_row])) if len(t.block_row) else np.zeros(0, np.int64)
                h, p = own[t.block_row][of_block], t.block_path[of_block]
                fresh = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]) if len(h) else np.zeros(0, np.int64)
                total = lambda x, fresh=fresh, of_block=of_block: np.add.reduceat(x[of_block], fresh) if len(fresh) else np.zeros(0, np.int64)
                names, paths, none = pa.array(hosts, pa.string()), pa.array(t.paths, pa.string()), pa.nulls(len(fresh), pa.int64())
                long = lambda x, y: pa.concat_arrays([pa.array(np.asarray(x).astype(np.int64)), y if isinstance(y, pa.Array) else pa.array(np.asarray(y).astype(np.int64))])
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(np.r_[own[row[edge]], h[fresh]])), long(t.key[at].view(np.int64), none), paths.take(pa.array(np.r_[t.path[at], p[fresh]])), pa.concat_arrays([pa.array(t.word[at]), pa.nulls(len(fresh), pa.bool_())]),
                    long(np.diff(np.r_[edge, len(spot)]), none), long(add(count), total(t.block_words)),
                    long(np.minimum.reduceat(count, edge) if len(edge) else [], none), long(np.maximum.reduceat(count, edge) if len(edge) else [], none),
                    long(add((mark & np.uint64(0xFFFFFFFF)).astype(np.int64)), none), long(add((mark >> np.uint64(32)).astype(np.int64)), none), long(np.zeros(len(edge)), total(t.block_chars)),
                ], [f.split()[0] for f in STATS.split(", ")])

    parts = pages.select("host", "page", "lines", "paths", "marks", "opens", "starts", "tokens").mapInArrow(run, STATS)
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2", "chars")]
    return parts.groupBy("host", "token", "path", "word").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))


def classes_of(stats: DataFrame, support: float, least_class: int) -> DataFrame:
    """(host, token, path, word, pages, total, class, root): the tokens of classes on at least `support` of the host's
    pages. A token counts if its number on a page is always the same; of these, tokens on the same pages are one class."""
    roots = stats.where("path = '' and not word").select("host", F.col("pages").alias("all"), F.col("v1").alias("r1"), F.col("v2").alias("r2"))
    steady = stats.where("token is not null").join(roots, "host").where((F.col("pages") >= support * F.col("all")) & (F.col("least") == F.col("most")))
    size = steady.groupBy("host", "v1", "v2").agg(F.count("*").alias("members"))
    root = (F.col("v1") == F.col("r1")) & (F.col("v2") == F.col("r2"))
    valid = steady.join(size, ["host", "v1", "v2"]).where(root | (F.col("members") >= least_class))
    return valid.select("host", "token", "path", "word", "pages", "total", "least", F.xxhash64("v1", "v2").alias("class"), root.alias("root"))


def order_and_nesting(pages: DataFrame) -> DataFrame:
    """Of pages with members array<struct<token, class, root>>: (host, kind, a, b, n) with kind 'order': on n pages token b (0: none)
    is before token a in its class; kind 'gap': on n pages class a is whole within the gap of the root class after its token b."""

    def run(batches):
        for batch in batches:
            for t in tokens_of(batch):
                hosts, own, members = _of_hosts(batch, t, "members")
                wanted = members.field("token").to_numpy().view(np.uint64)
                turn = np.argsort(wanted)
                wanted, of, root = wanted[turn], members.field("class").to_numpy()[turn], members.field("root").to_numpy(zero_copy_only=False)[turn]
                spot = np.searchsorted(wanted, t.key)
                spot[spot == len(wanted)] = 0
                hit = np.flatnonzero(wanted[spot] == t.key) if len(wanted) else np.zeros(0, np.int64)
                # the first occurrence of each member on each page, in page order
                order, first, _ = _grouped(t.row[hit], spot[hit])
                hit = np.sort(hit[order][first])
                spot, row = spot[hit], t.row[hit]
                key, cls, is_root = wanted[spot], of[spot], root[spot]
                # the root token before each; a page's first token is the root itself
                last = np.maximum.accumulate(np.where(is_root, np.arange(len(hit)), 0)) if len(hit) else np.zeros(0, np.int64)
                gap = key[last] if len(hit) else key
                by = np.lexsort((np.arange(len(hit)), cls, row))
                start = np.ones(len(by), bool)
                if len(by) > 1:
                    start[1:] = (row[by][1:] != row[by][:-1]) | (cls[by][1:] != cls[by][:-1])
                before = np.where(start, np.uint64(0), np.r_[np.zeros(min(1, len(by)), np.uint64), key[by][:-1]])
                head = np.flatnonzero(start)
                tail = np.r_[head[1:] - 1, [len(by) - 1] * (len(head) > 0)].astype(np.int64)
                inner = ~is_root[by][head]
                one = gap[by][head] == gap[by][tail]
                head, one = head[inner], one[inner]
                a = np.r_[key[by], cls[by][head].view(np.uint64)]
                b = np.r_[before, np.where(one, gap[by][head], np.uint64(0))]
                kind = np.r_[np.zeros(len(by), np.int64), np.ones(len(head), np.int64)]
                host = own[np.r_[row[by], row[by][head]]]
                order, first, count = _grouped(host, kind, a, b)
                pick = order[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hosts, pa.string()).take(pa.array(host[pick])), pa.array(["order", "gap"]).take(pa.array(kind[pick])), pa.array(a[pick].view(np.int64)), pa.array(b[pick].view(np.int64)), pa.array(count)],
                    ["host", "kind", "a", "b", "n"],
                )

    parts = pages.select("host", "lines", "paths", "marks", "opens", "starts", "members").mapInArrow(run, "host string, kind string, a long, b long, n long")
    return parts.groupBy("host", "kind", "a", "b").agg(F.sum("n").alias("n"))


def template_tokens(classes: DataFrame, seen: DataFrame, support: float) -> DataFrame:
    """The tokens of classes whose place in the order of their class, and whose class's gap in the root class, is one on `support` of their pages."""
    place = seen.where("kind = 'order'").groupBy("host", F.col("a").alias("token")).agg(F.max("n").alias("ordered"))
    gap = seen.where("kind = 'gap' and b <> 0").groupBy("host", F.col("a").alias("class")).agg(F.max("n").alias("nested"))
    return (
        classes.join(place, ["host", "token"]).join(gap, ["host", "class"], "left")
        .where((F.col("ordered") >= support * F.col("pages")) & (F.col("root") | (F.col("nested") >= support * F.col("pages"))))
        .drop("ordered", "nested")
    )


def templates(tokens: DataFrame, stats: DataFrame, holds: float, constant: float, most_constant: float) -> DataFrame:
    """(host, slot, dropped array<string>): each host's article slot and its containers of constant text.

    The slot is the innermost container, once a page, with at least `holds` of the host's text outside constant containers and
    marked boilerplate, and with its title: the h1 of the template with most such text, if there is one. A host whose constant containers
    hold more than most_constant of its text has near copies rather than a template, and gets none."""
    own = tokens.where("word").groupBy("host", "path").agg(F.sum("total").alias("fixed"))
    paths = stats.where("token is null").select("host", "path", F.col("total").alias("words"), "chars").join(own, ["host", "path"], "left")
    paths = paths.withColumn("constant", F.coalesce(F.col("fixed"), F.lit(0)) >= constant * F.col("words"))
    whole = paths.groupBy("host").agg(
        F.sum("chars").alias("chars"), F.sum(F.when(~F.col("constant"), F.col("chars")).otherwise(0)).alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("constant"), F.col("path")))).alias("dropped"),
    ).where((F.col("chars") - F.col("text") <= most_constant * F.col("chars")) & (F.col("text") > 0))
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    inside = paths.where("not constant and chars > 0").select("host", above.alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("inside"))
    held = tokens.where("not word and least = 1").select("host", "path").join(inside, ["host", "path"])
    title = held.where(F.element_at(F.split("path", "/"), -1).rlike(r"^h1(\.|$)")).groupBy("host").agg(F.max_by("path", F.struct("inside", "path")).alias("title"))
    best = held.join(whole, "host").join(title, "host", "left").where((F.col("inside") >= holds * F.col("text")) & (F.col("title").isNull() | F.expr("startswith(title, concat(path, '/'))")))
    return best.groupBy("host").agg(F.max_by("path", F.struct(F.size(steps), "path")).alias("slot"), F.first("dropped").alias("dropped"))


def host_templates(
    table: DataFrame, support: float = SUPPORT, holds: float = HOLDS, least_pages: int = LEAST_PAGES, least_class: int = LEAST_CLASS, constant: float = CONSTANT, most_constant: float = MOST_CONSTANT, most_broadcast: int = MOST_BROADCAST,
    most_run: int = MOST_RUN, known: float = KNOWN,
) -> tuple[DataFrame, DataFrame]:
    """The table of parsed pages with paths of known labels, and its templates (host, slot, dropped, cut array<long>: runs of template text); hosts of fewer than
    least_pages distinct pages have none, nor has the host ''."""
    pages = distinct_pages(table.where("host <> ''"), most_broadcast)
    sizes = written(pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages))
    enough = sizes.select("host")
    pages = _near(pages, enough, ["host"], "left_semi", most_broadcast)
    labels = written(enough.join(known_labels(pages, sizes, known), "host", "left"))
    table, pages = (with_known(x, labels, most_broadcast // 10) for x in (table, pages))
    wanted = written(candidates(pages, support))
    stats = written(occurrence_stats(_near(pages, wanted, ["host"], "inner", most_broadcast // 10)))
    classes = written(classes_of(stats, support, least_class))
    members = written(classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "root")).alias("members")))
    seen = order_and_nesting(_near(pages, members, ["host"], "inner", most_broadcast // 10))
    tokens = written(template_tokens(classes, seen, support))
    # a run is template words altogether: its share of them is 1
    cut = _on_many(pages, F.array_compact(_runs(most_run)), sizes, support, "cut").where(F.lit(1.0) >= F.lit(constant))
    return table, written(templates(tokens, stats, holds, constant, most_constant).join(cut, "host", "left"))


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """(id_col, url_col, text, n_chars), one row per row of pages: the blocks of the host's article slot joined by a line end.

    Within the slot, constant containers and slots that are marked as menus, headers, footers, sidebars, notices, adverts, forms or comments
    (markup.py) are left out; names of class, id and role count whole ("sidebar", not "has-sidebar"), and a
    container that wraps the page's article is never marked. Constant text that shares its container with changing text goes if it is a run between two tags of at
    most MOST_RUN words, and stays if it is longer, as a passage that a host's articles share. Classes and ids that few of a host's pages have tell no containers apart.
    Character references are decoded and white space in a block is one space. Pages of hosts without a template (few distinct pages, no host) and pages without their
    host's slot give their own article or main element, or else all their blocks outside marked boilerplate; a page of
    nothing else gives its text all the same. Null or empty html gives ''. A null or
    odd url is the host ''. Repeated rows and ids are kept, one row each, and count once as evidence; other columns are not read."""
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    table = written(parsed_pages(rows))
    table, found = host_templates(table, most_broadcast=most_broadcast, **options)
    # per block, whether it is a run of its host's template
    fixed = F.transform(_runs(options.get("most_run", MOST_RUN)), lambda h: F.coalesce(F.array_contains("cut", h), F.lit(False)))
    joined = _near(table.select("host", "key", "url", "lines", "paths", "marks"), found, ["host"], "left", most_broadcast // 10).select("key", "url", "lines", "paths", "marks", "slot", "dropped", fixed.alias("fixed"))

    def run(batches):
        for batch in batches:
            out = []
            for lines, paths, marks, slot, dropped, runs in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                every = [Block(*x) for x in zip(paths, marks, lines, strict=True)]
                blocks = [b for b, run in zip(every, runs, strict=True) if not run] or every
                fixed = frozenset(dropped or ())
                text = "" if slot is None else "\n".join(b.text for b in blocks if b.boiler == CLEAN and b.path not in fixed and (b.path == slot or b.path.startswith(slot + "/")))
                if not text:
                    clean = clean_blocks(blocks)
                    clean = [b for b in clean if b.path not in fixed] or clean
                    for inside in (lambda p: "/article" in p or "/main" in p, lambda p: True):
                        text = "\n".join(b.text for b in clean if inside(b.path))
                        if text:
                            break
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
