"""SimHash near-duplicates by BK-trees.

Every text becomes 64 bits, each the majority of that bit over the hashes of its word shingles. Two fingerprints that differ in at most r bits agree on
some k - r of k blocks of their bits, so each distinct fingerprint goes to one shard for every choice of k - r blocks, the shard of
those that agree with it there. A shard has a BK-tree, whose children hang on their distance to the parent; a query follows the edges within r of
its own distance only. Trees larger than a bound are cut into pieces: each piece links its own members first, and then, per shard, all members outside its
largest component meet every piece. Only links that join something are handed on, one per member at most.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_words, text_slices, word_hashes, written
from .components import connected_components

#: Members of a tree at most, about; of a shard on average, by which the number of blocks is chosen; rows per task of many shards.
TREE_ROWS, SHARD_ROWS, TASK_ROWS = 4096, 256, 100_000
#: Places in trees that one search holds at a time; shingles whose bits are counted at a time.
FRONTIER, BITS_AT_ONCE = 4_000_000, 1 << 18
SEED = 42


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long), a row for each row of docs: bit b is 1 if it is in over half the XXH64 (seed 42) of the k-word shingles, repeats included."""

    def run(batches):
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column(1)):
                data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
                _, first = word_hashes(data, offsets, lower=False)
                fp = _simhash(joined_words(data, offsets, first), np.diff(first), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def _simhash(texts: pa.StringArray, words: np.ndarray, k: int) -> np.ndarray:
    """Of texts whose words are joined by one space, the fingerprints."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2].to_pybytes()[: offsets[-1]]
    data = np.frombuffer(raw, np.uint8)
    lead = np.r_[True, data[:-1] == 32] if len(data) else np.zeros(0, bool)
    lead[offsets[:-1][words > 0]] = True
    start = np.flatnonzero(lead)
    stop = np.r_[start[1:] - 1, len(data)]
    last = np.cumsum(words)[words > 0] - 1
    stop[last] = offsets[1:][words > 0]
    several = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    rows = np.repeat(np.arange(len(words)), several)
    head = np.arange(len(rows)) - np.repeat(np.cumsum(several) - several, several) + np.repeat(np.cumsum(words) - words, several)
    tail = head + np.minimum(k, words[rows]) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((len(words), 64), np.int64)
    for lo in range(0, len(rows), BITS_AT_ONCE):
        part = slice(lo, lo + BITS_AT_ONCE)
        h = np.array([digest(raw[a:b], SEED) for a, b in zip(start[head[part]].tolist(), stop[tail[part]].tolist(), strict=True)], np.uint64)
        edge = np.flatnonzero(np.r_[True, np.diff(rows[part]) > 0])
        counts[rows[part][edge]] += np.add.reduceat(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), edge, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > several[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class BKTrees:
    """One BK-tree for each run of equal trees (ascending); the first member of a group is its root, the others hang below it by distance."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray):
        self.fp = fp
        self.size = np.bincount(tree) if len(tree) else np.zeros(0, np.int64)
        self.root = np.zeros(len(self.size), np.int64)
        keys, nodes = [], []
        rest, key = np.arange(len(fp)), tree.astype(np.int64)
        top = True
        while len(rest):
            turn = np.argsort(key, kind="stable")
            rest, key = rest[turn], key[turn]
            head = np.r_[True, key[1:] != key[:-1]]
            node = rest[head]
            if top:
                self.root[key[head]] = node
                top = False
            else:
                keys.append(key[head])
                nodes.append(node)
            parent = np.repeat(node, np.diff(np.r_[np.flatnonzero(head), len(rest)]))[~head]
            rest = rest[~head]
            key = parent * 65 + np.bitwise_count(fp[rest] ^ fp[parent])
        edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        turn = np.argsort(edge)
        #: parent * 65 + distance, ascending, and the child there
        self.edge, self.child = edge[turn], (np.concatenate(nodes) if nodes else edge)[turn]

    def search(self, tree: np.ndarray, fp: np.ndarray, radius: int):
        """(query, member) pairs within the radius, in parts: query q looks through tree[q]."""
        at = 0
        ahead = np.cumsum(self.size[tree])
        while at < len(tree):
            end = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + FRONTIER, "right")))
            query, node = np.arange(at, min(end, len(tree))), self.root[tree[at:end]]
            at = end
            while len(query):
                d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                # edges from d - radius to d + radius are a stretch of the sorted ones
                lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - lo
                query = np.repeat(query, n)
                node = self.child[np.repeat(lo, n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Ties the components of a and b in label, in place; every label is its component's least index."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bit masks of every choice of blocks - radius of so many blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(own[i] for i in some) for some in combinations(range(blocks), blocks - radius)]


def choose_blocks(count: int, radius: int, shard_rows: int = SHARD_ROWS) -> int:
    """The least number of blocks by which shards of `count` random fingerprints have about shard_rows members at most."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and count >> min(m.bit_count() for m in block_masks(blocks, radius)) > shard_rows:
        blocks += 1
    return blocks


def _links(found: DataFrame, name: str, queries: DataFrame | None, radius: int) -> DataFrame:
    """(a, b) fingerprints to join. found: (task, tree, fp); with queries (task, tree, fp), those search the trees, else the members do."""

    def run(members: pa.Table, asked: pa.Table | None = None) -> pa.Table:
        trees, fp = members["tree"].to_numpy(), members["fp"].to_numpy().view(np.uint64)
        turn = np.lexsort((fp, trees))
        names, tree = np.unique(trees[turn], return_inverse=True)
        fp = fp[turn]
        if asked is None:
            search_in, search, shift = tree, fp, 0
        else:
            have = pa.compute.is_in(asked["tree"], value_set=pa.array(names))
            asked = asked.filter(have)
            search_in, search, shift = np.searchsorted(names, asked["tree"].to_numpy()), asked["fp"].to_numpy().view(np.uint64), len(fp)
        every = fp if asked is None else np.r_[fp, search]
        label = np.arange(len(every))
        for query, node in BKTrees(tree, fp).search(search_in, search, radius) if len(fp) else ():
            joined(label, query + shift, node)
        tied = np.flatnonzero((label != np.arange(len(label))) & (every != every[label]))
        return pa.table({"a": pa.array(every[tied].view(np.int64)), "b": pa.array(every[label[tied]].view(np.int64))})

    grouped = found.groupBy(name)
    if queries is None:
        return grouped.applyInArrow(lambda t: run(t), "a long, b long")
    return grouped.cogroup(queries.groupBy(name)).applyInArrow(lambda t, q: run(t, q), "a long, b long")


def linked(nodes: DataFrame, radius: int = 4, tree_rows: int = TREE_ROWS, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp long) that join everything within the radius, directly or over others."""
    count = nodes.count()
    masks = block_masks(choose_blocks(count, radius, shard_rows), radius)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    shard = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(signed(m))) for i, m in enumerate(masks)]))
    members = nodes.select("fp", shard.alias("shard"))
    tasks = max(1, -(-count * len(masks) // task_rows))
    large = written(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_rows).select("shard", F.ceil(F.col("n") / tree_rows).alias("pieces")))
    placed = members.join(large, "shard", "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("fp"), F.col("pieces"))).otherwise(F.lit(0).cast("long")))
    tree = F.xxhash64("shard", "piece")
    # shards of one member link nothing, but are cheaper to carry than to count
    first = written(_links(placed.select(F.pmod(tree, F.lit(tasks)).alias("task"), tree.alias("tree"), "fp"), "task", None, radius))
    if large.isEmpty():
        return first
    reached = connected_components(first)
    label = F.coalesce("component", "fp").alias("label")
    split = written(placed.where("pieces > 1").join(reached, F.col("fp") == F.col("id"), "left").select("shard", "pieces", "piece", "fp", label))
    main = split.groupBy("shard", "label").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    minor = written(split.join(main, "shard").where("label <> main").select("shard", "pieces", "fp"))
    counts = minor.groupBy("shard").agg(F.ceil(F.count("*") / tree_rows).alias("blocks"))
    minor = written(minor.join(counts, "shard").select("shard", "pieces", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).alias("block"), "fp"))
    blocks = minor.select("shard", "block").distinct()
    unit = F.xxhash64("shard", "piece", "block").alias("unit")
    sides = split.join(blocks, "shard").select(unit, tree.alias("tree"), "fp")
    asked = minor.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select(unit, tree.alias("tree"), "fp")
    return first.union(_links(sides, "unit", asked, radius))


def simhash_components(
    docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    tree_rows: int = TREE_ROWS, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a text's shingles are its k-word sequences joined by spaces, repeats included; with fewer words, the
    whole sequence; null, empty and blank texts have none, and fingerprint zero, which links like any other. fingerprint: 16 hex
    digits. Rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest id reachable, the row's own included.
    Repeated ids are reported once per row and share nothing but the smallest id; a null id is carried, takes part in links, and never is the smallest while another
    one is there. An empty table gives none. Other columns are not read, so their names cannot clash. Equal fingerprints are one node
    from the start, so copies cost nothing; every search is exact."""
    flat = written(fingerprints(docs, k, id_col, text_col))
    nodes = written(flat.groupBy("fp").agg(F.min("id").alias("low")))
    reached = connected_components(linked(nodes.select("fp"), radius, tree_rows, shard_rows, task_rows))
    label = written(nodes.join(reached, F.col("fp") == F.col("id")).select("fp", "low", "component"))
    best = label.groupBy("component").agg(F.min("low").alias("best"))
    tied = label.join(best, "component").select("fp", "best").union(nodes.join(label, "fp", "left_anti").select("fp", "low"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return flat.join(tied, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("best").alias("component_id"))
