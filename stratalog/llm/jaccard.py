"""N-gram Jaccard join by grouped prefixes.

Every text becomes its set of distinct k-word shingles. Equal sets are one node from the start. Shingles are
ordered from rare to frequent; two sets with Jaccard similarity t share one of their rarest n - ceil(t n) + 1
shingles (the prefix). A shingle that one set alone holds links nothing, so it is left out of the prefix: most
texts are then done, and copies that differ by their own edits have the same prefix. Sets of the same prefix and
size form a group. Group leaders are paired through prefix shingles, leaders and members are verified, and
only prefix shingles whose sets are still in different components are looked at again, in chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, mix, pack_sorted, planes, shingle_sets, sums, unpack_sorted, unplanes, written
from .components import connected_components

#: Bytes kept of each shingle hash for verification.
WIDTH = 6
#: Shingles per block and per count part.
BLOCK = 2_000_000
#: Sets per side of a verification task.
CHUNK = 128
#: Rows to drop that are broadcast; beyond, all rows are shuffled to them.
MOST_BROADCAST = 1_000_000


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _sets(docs: DataFrame, k: int, blocks: int, bodies: bool) -> DataFrame:
    """Per row (id, row, n, h1, h2), row being a hash of it; with bodies, per set that a task meets first (block, h1, h2, n, body)."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, end, tokens, offsets in shingle_sets(texts, k):
                n = np.diff(offsets)
                h1 = sums(mix(tokens ^ np.uint64(0x51ED270B9F0A77C3)), offsets) + n.astype(np.uint64)
                h2 = sums(mix(tokens + np.uint64(0x2545F4914F6CDD1D)), offsets)
                if not bodies:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, end - at), batch.column(2).slice(at, end - at), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "row", "n", "h1", "h2"]
                    )
                    continue
                keep = []
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if n[i] and key not in seen:
                        seen.add(key)
                        keep.append(i)
                raw = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]
                body = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h1[keep] % np.uint64(blocks)).astype(np.int64)), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), pa.array(n[keep]), binary_array(body)],
                    ["block", "h1", "h2", "n", "body"],
                )

    schema = "block long, h1 long, h2 long, n long, body binary" if bodies else "id long, row long, n long, h1 long, h2 long"
    return docs.mapInArrow(run, schema)


def _tokens(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(body, np.uint8).reshape(-1, WIDTH)
    return np.unique(out.view("<u8").ravel().astype(np.uint64))


def _block(table: pa.Table, bits: int):
    """The block's distinct sets in a fixed order: (h1, h2, n, bodies, tokens, offsets, count keys of the tokens)."""
    h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
    order = np.lexsort((h2, h1))
    if len(order) > 1:
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        order = order[np.r_[True, ~same]]
    bodies = table["body"].take(pa.array(order)).to_pylist()
    parts = [_tokens(b) for b in bodies]
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    offsets = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
    return h1[order], h2[order], table["n"].to_numpy()[order], bodies, tokens, offsets, tokens >> np.uint64(8 * WIDTH - bits)


def _counts(base: DataFrame, parts: int, bits: int) -> DataFrame:
    """(block, part, codes): for each block's distinct count keys, ascending, a code that grows with the number
    of sets in the corpus that hold the key (1: no other set)."""

    def ask(table: pa.Table) -> pa.Table:
        *_, offsets, keys = _block(table, bits)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keys = np.sort(keys) if len(keys) else keys  # a set's tokens may share a key: it then counts twice, which is safe
        uniq, counts = np.unique(keys, return_counts=True)
        part = ((uniq >> np.uint64(max(0, bits - 32))) * np.uint64(parts)) >> np.uint64(min(32, bits))
        edges = np.searchsorted(part, np.arange(parts + 1))
        del rows
        got = [(p, pack_sorted(uniq[a:b]), planes(counts[a:b], 4)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        block = table["block"][0].as_py()
        return pa.table({"part": pa.array([g[0] for g in got], pa.int64()), "block": pa.array([block] * len(got), pa.int64()), "keys": binary_array([g[1] for g in got]), "own": binary_array([g[2] for g in got])})

    def tell(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        own = [unplanes(x) for x in table["own"].to_pylist()]
        every = np.concatenate(keys)
        uniq, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(own)).astype(np.int64)
        codes = np.where(total < 100, total, np.minimum(99 + np.log2(np.maximum(total, 100) / 100) * 6 + 1, 255)).astype(np.uint8)[inverse]
        edges = np.r_[0, np.cumsum([len(k) for k in keys])]
        out = [planes(codes[a:b], 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"block": pa.array(blocks, pa.int64()), "part": table["part"], "codes": binary_array(out)})

    asked = base.groupBy("block").applyInArrow(ask, "part long, block long, keys binary, own binary")
    return asked.groupBy("part").applyInArrow(tell, "block long, part long, codes binary")


def _candidates(base: DataFrame, codes: DataFrame, percent: int, bits: int) -> DataFrame:
    """(h1, h2, n, body, prefix): the sets with a prefix shingle that another set holds."""

    def run(sets: pa.Table, told: pa.Table) -> pa.Table:
        out: dict = {"h1": [], "h2": [], "n": [], "body": [], "prefix": []}
        if sets.num_rows:
            h1, h2, n, bodies, tokens, offsets, keys = _block(sets, bits)
            told = told.sort_by("part")
            rank = np.concatenate([unplanes(x) for x in told["codes"].to_pylist()]).astype(np.uint8) if told.num_rows else np.zeros(0, np.uint8)
            uniq, inverse = np.unique(keys, return_inverse=True)
            code = rank[inverse] if len(uniq) else np.zeros(0, np.uint8)
            alone = sums((code == 1).astype(np.int64), offsets)
            room = prefix_length(n, percent)
            for i in np.flatnonzero(alone < room).tolist():
                a, b = offsets[i], offsets[i + 1]
                order = np.lexsort((tokens[a:b], code[a:b]))[alone[i] : room[i]]
                if len(order):
                    for name, value in zip(out, (int(h1[i]), int(h2[i]), int(n[i]), bodies[i], tokens[a:b][order].astype(np.int64).tolist()), strict=True):
                        out[name].append(value)
        return pa.table([pa.array(out["h1"], pa.int64()), pa.array(out["h2"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["body"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))], names=list(out))

    return base.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, "h1 long, h2 long, n long, body binary, prefix array<long>")


def _verify(units: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between each unit's two sides. Both tables: (unit long, id, label, n, body); pairs of one
    label are connected already and skipped."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if x.num_rows and y.num_rows:
            xs = list(zip(x["id"].to_pylist(), x["label"].to_pylist(), x["n"].to_pylist(), x["body"].to_pylist(), strict=True))
            sets = [_tokens(b) for b in y["body"].to_pylist()]
            edges = np.r_[0, np.cumsum([len(s) for s in sets])]
            every = np.concatenate(sets)
            uniq, inverse = np.unique(every, return_inverse=True)
            ids, labels, n = y["id"].to_numpy(), y["label"].to_numpy(), y["n"].to_numpy()
            for i, label, size, body in xs:
                fits = (labels != label) & (ids != i) & (100 * n >= percent * size) & (100 * size >= percent * n)
                if not fits.any():
                    continue
                mine = _tokens(body)
                at = np.searchsorted(uniq, mine)
                at[at == len(uniq)] = 0
                mark = np.zeros(len(uniq), np.int64)
                mark[at[uniq[at] == mine]] = 1
                both = sums(mark[inverse], edges)
                for j in ids[fits & (100 * both >= percent * (n + size - both))].tolist():
                    found_a.append(i)
                    found_b.append(j)
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    names = ["unit", "id", "label", "n", "body"]
    left, units = left.select(names).toDF(*names), units.select(names).toDF(*names)  # new columns: both sides may have one source
    return left.groupBy("unit").cogroup(units.groupBy("unit")).applyInArrow(run, "a long, b long")


def _hash(*cols) -> F.Column:
    return F.xxhash64(*cols)


def _labelled(docs: DataFrame, row: F.Column, id_col: str, text_col: str, k: int, percent: int, block: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, n, h1, h2) per row of docs, and per distinct set (h1, h2, low, label): its smallest id, and a number that it shares
    with all sets that links reach from it. Sets, not ids, are linked, so a repeated id ties nothing and a null one loses nothing."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    flat = written(_sets(docs, k, 1, bodies=False))
    alike = flat.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("low")).withColumn("node", _hash("h1", "h2"))
    tokens = flat.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(tokens / block))
    bits = min(8 * WIDTH, max(32, int(tokens).bit_length() + 6))
    base = _sets(docs.drop("row"), k, blocks, bodies=True)
    found = written(_candidates(base, _counts(base, blocks, bits), percent, bits))
    nodes = written(found.select(_hash("h1", "h2").alias("id"), "n", "body", "prefix", _hash("n", "prefix").alias("g")))
    reached = connected_components(_links(nodes, percent, chunk))
    return flat, alike.join(reached, F.col("node") == F.col("id"), "left").select("h1", "h2", "low", F.coalesce("component", "node").alias("label"), F.col("component").isNotNull().alias("tied"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered. A row's set is its distinct k-word shingles; with fewer words
    the whole sequence is one shingle. Rows link when 100 * intersection >= percent * union; component_id is the
    smallest id reachable. Null, empty and blank texts have no shingle and are alone with their own id. Repeated
    texts share a component. A repeated id is reported once per row, and does not link its rows; a null id is carried, takes part in links, and never is the
    smallest while another one is there. Other columns are not read, so their names cannot clash. Sets are compared by
    64-bit shingle hashes, cut to 48 bits in verification, and named by 64-bit hashes."""
    flat, sets = _labelled(docs, F.lit(0).cast("long"), id_col, text_col, k, percent, block, chunk)
    sets = written(sets)
    tied = sets.where("tied")
    best = tied.groupBy("label").agg(F.min("low").alias("best"))
    part = tied.join(best, "label").select("h1", "h2", "best").union(sets.where("not tied").select("h1", "h2", "low"))
    return flat.join(part.withColumn("some", F.lit(True)), ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("some"), F.col("best")).otherwise(F.col("id")).alias("component_id"),
    )


def _links(nodes: DataFrame, percent: int, chunk: int) -> DataFrame:
    slim = nodes.select("id", "n", "g", "prefix")
    # groupings are written before they are joined: a hot group or shingle is then a skewed join, which is split
    groups = written(slim.groupBy("g").agg(F.min("id").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    # leaders of groups meet the leader of each prefix shingle and size class; members meet their group's leader
    size_class = F.floor(F.log("n") / F.lit(math.log(100 / percent) or 1.0))
    entry = groups.select("gid", F.explode("prefix").alias("t"), size_class.alias("c"))
    lead = written(entry.groupBy("t", "c").agg(F.min("gid").alias("lead")))
    first = (
        entry.join(lead, ["t", "c"]).where("gid <> lead").select(F.col("gid").alias("a"), F.col("lead").alias("b"))
        .union(slim.join(groups.select("g", "gid"), "g").where("id <> gid").select(F.col("id").alias("a"), F.col("gid").alias("b")))
        .distinct()
    )
    sides = first.groupBy("b").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("k"))
    body = nodes.select("id", F.col("id").alias("label"), "n", "body")
    many = first.join(sides, "b").select("a", _hash("b", F.pmod(_hash("a"), F.col("k"))).alias("unit"))
    one = sides.select("b", F.explode(F.sequence(F.lit(0), F.col("k").cast("long") - 1)).alias("s"), "k").select(F.col("b").alias("id"), _hash("b", "s").alias("unit"))
    links = written(_verify(many.withColumnRenamed("a", "id").join(body, "id"), one.join(body, "id"), percent))
    # what is left: prefix shingles whose sets lie in different components
    reached = connected_components(links)
    tagged = slim.join(reached, "id", "left").select("id", "g", "prefix", F.coalesce("component", "id").alias("label"))
    entry = written(tagged.select("id", "label", F.explode("prefix").alias("t")))
    open_ = written(entry.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("lead")).where("lo < hi"))
    live = entry.join(open_.select("t", "lead"), "t")
    home = live.groupBy("id").agg(F.min("lead").alias("home"), F.first("label").alias("label"))
    k = home.groupBy("home").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("k"))
    home = written(home.join(k, "home").select("id", "label", _hash("home", F.pmod(_hash("id"), F.col("k"))).alias("chunk")))
    cell = (
        live.select("t", "id").join(home, "id").groupBy("t", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    )
    x, y = cell.alias("x"), cell.alias("y")
    pairs = written(
        x.join(y, F.col("x.t") == F.col("y.t")).where("x.chunk <= y.chunk and (x.lo <> y.lo or x.hi <> y.hi or x.lo <> x.hi)")
        .select(F.col("x.chunk").alias("p"), F.col("y.chunk").alias("q")).distinct().withColumn("unit", _hash("p", "q"))
    )
    body = home.join(nodes.select("id", "n", "body"), "id")
    side = lambda c: pairs.select("unit", F.col(c).alias("chunk")).join(body, "chunk").select("unit", "id", "label", "n", "body")
    return links.union(_verify(side("p"), side("q"), percent))


def jaccard_dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block: int = BLOCK, chunk: int = CHUNK, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of near copies stays (five-word shingles, similarity 0.8).

    Rows count, not ids: the row of the smallest id stays, of equal ids that of the smallest row hash, and rows without an id
    only where the group has no other. Of rows that are equal in all columns one stays. Texts without words are no group, so all their rows stay. An id on two different
    texts is two documents. Rows are told apart by a 64-bit hash of their columns, maps and variants left out."""
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.xxhash64(*hashed, F.lit(k))
    flat, sets = _labelled(docs, row, id_col, text_col, k, percent, block, chunk)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    # equal sets first, so that no group of copies is joined or sorted as a whole
    first = flat.where("n > 0").groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    part = written(sets.join(first, ["h1", "h2"]).select("h1", "h2", "label", "first", "rows"))
    stays = part.groupBy("label").agg(F.min("first").alias("stays"), F.sum("rows").alias("rows")).where("rows > 1")
    groups = part.drop("rows").join(stays, "label").select("h1", "h2", "stays")
    stay = F.col("row").eqNullSafe(F.col("stays.row")) & F.col("id").eqNullSafe(F.col("stays.id"))
    pick = written(flat.where("n > 0").join(groups, ["h1", "h2"]).groupBy("id", "row").agg(F.first(stay).alias("stay"), F.count("*").alias("times")))
    body, text = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), F.col(id_col).cast("long")
    whole = docs.select(body.alias("body"), text.alias("id"), row.alias("row"))
    same = lambda other: whole["row"].eqNullSafe(other["row"]) & whole["id"].eqNullSafe(other["id"])
    gone, twice = pick.where("not stay"), pick.where("stay and times > 1")
    # the few keys go to the rows, not the whole rows to the keys
    left = whole.join(F.broadcast(gone) if gone.count() <= most_broadcast else gone, same(gone), "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, same(twice), "left_anti").union(left.join(twice, same(twice), "left_semi").dropDuplicates(["id", "row"]))
    return left.select(*[F.col(f"body.c{i}").alias(c) for i, c in enumerate(docs.columns)])
