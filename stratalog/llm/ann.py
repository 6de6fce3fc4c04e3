"""Nearest neighbours by vantage-point trees, one per shard.

The largest inner product becomes the smallest Euclidean distance when every vector gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm, and queries get 0 there. A shard's tree halves its rows by distance to a
vantage point; each leaf has, from the triangle inequality along its path, a least distance to a query, and is skipped
once that, times `slack`, exceeds the query's k-th best. With slack 1 the search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors per shard, queries per block, blocks per task, shards per task at most, vectors per leaf.
SHARD_ROWS, QUERY_ROWS, GROUP_BLOCKS, GROUP_SHARDS, LEAF_ROWS = 4096, 512, 16, 8, 128


class VantageTree:
    """Leaves in path order, with each leaf's vantage points and distance intervals."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        self.points: list[int] = []
        todo = [(np.arange(len(x)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf_rows:
                if len(rows):
                    self.leaves.append(rows)
                    self.paths.append(path)
                continue
            # the row farthest from the first one splits best; the choice does not touch results
            at = rows[np.argmax(((x[rows] - x[rows[0]]) ** 2).sum(axis=1))]
            d = np.sqrt(((x[rows] - x[at]) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            v = len(self.points)
            self.points.append(int(at))
            for part in (order[:half], order[half:]):
                todo.append((rows[part], [*path, (v, float(d[part].min()), float(d[part].max()))]))

    def least_distances(self, to_points: np.ndarray) -> np.ndarray:
        """(queries x leaves) lower bounds from the queries' distances to the vantage points."""
        out = np.zeros((len(to_points), len(self.leaves)))
        for i, path in enumerate(self.paths):
            for v, lo, hi in path:
                d = to_points[:, v]
                np.maximum(out[:, i], np.maximum(lo - d, d - hi), out=out[:, i])
        return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return out


def search_shard(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, top: float, k: int, slack: float, leaf_rows: int = LEAF_ROWS):
    """Per query its k best of this shard: (query index, ids, scores), best first, ties to smaller ids.

    Equal vectors are one point of the tree with its k + 1 smallest ids: no other of them can be among the k best."""
    order = np.lexsort((ids, *x.T))
    same = np.r_[False, (x[order][1:] == x[order][:-1]).all(axis=1)]
    first = np.flatnonzero(~same)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    point = np.cumsum(~same) - 1
    kept = rank <= k
    copies, copy_of = ids[order][kept], point[kept]
    copy_edge = np.searchsorted(copy_of, np.arange(len(first) + 1))
    p = x[order][first]
    up = np.concatenate([p, np.sqrt(np.maximum(top * top - (p * p).sum(axis=1), 0.0))[:, None]], axis=1)
    q_up = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    tree = VantageTree(up, leaf_rows)
    norm = (q * q).sum(axis=1) + top * top
    v = up[tree.points] if tree.points else np.zeros((0, up.shape[1]))
    least = tree.least_distances(np.sqrt(np.maximum((q_up * q_up).sum(axis=1)[:, None] + (v * v).sum(axis=1) - 2 * q_up @ v.T, 0.0)))
    eps = 1e-6 * (1 + top)  # rounding never prunes
    best_d = np.full((len(q), k + 1), np.inf)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
    turn = np.argsort(least, axis=1, kind="stable")
    n_copies = np.diff(copy_edge)
    for step in range(len(tree.leaves)):
        leaf_of = turn[:, step]
        bound = least[np.arange(len(q)), leaf_of]
        live = bound * slack <= best_d[:, k] + eps
        for leaf in np.unique(leaf_of[live]).tolist():
            who = np.flatnonzero(live & (leaf_of == leaf))
            rows = tree.leaves[leaf]
            s = q[who] @ p[rows].T
            d = np.sqrt(np.maximum(norm[who][:, None] - 2 * s, 0.0))
            # distances count once per copy, k + 1 at most
            many = np.repeat(d, np.minimum(n_copies[rows], k + 1), axis=1)
            both = np.concatenate([best_d[who], many], axis=1)
            best_d[who] = np.sort(np.partition(both, k, axis=1)[:, : k + 1], axis=1)
            for w, i in enumerate(who.tolist()):
                near = d[w] <= best_d[i, k] + eps
                found[i].append((rows[near], d[w][near]))
    for i in range(len(q)):
        rows = np.concatenate([r for r, d in found[i]]) if found[i] else np.zeros(0, np.int64)
        dist = np.concatenate([d for r, d in found[i]]) if found[i] else np.zeros(0)
        rows = rows[dist <= best_d[i, k] + eps]
        if not len(rows):
            continue
        score = _products(np.repeat(q[i][None], len(rows), axis=0), p[rows])
        cand = np.concatenate([copies[copy_edge[r] : copy_edge[r + 1]] for r in rows.tolist()])
        score = np.repeat(score, n_copies[rows])
        ok = cand != q_ids[i]
        cand, score = cand[ok], score[ok]
        best = np.lexsort((cand, -score))[:k]
        yield i, cand[best], score[best]


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, slack: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf_rows: int = LEAF_ROWS, group_shards: int = GROUP_SHARDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, its k rows of largest inner product
    among all other rows, best first, ties to smaller ids; all, if fewer.

    slack 1 is exact; more skips more leaves at the cost of recall (README: figures). Vectors that are null, zero, or hold null, NaN or
    infinite components take no part, nor do rows with a null id; vectors of another length than the most common one take no part. Rows that share an id are different
    candidates with one id; queries that share an id share one list; a query's own id is never its neighbour. Vectors are scaled by a power of two, so large or small ones
    neither overflow nor vanish in the search; a score beyond the range of doubles is infinite. Shards are hashed by id, so hot labels or copies spread.
    Query blocks meet every shard: blocks and shards are packed arrays, and a task hands on k rows per query for up to group_shards shards."""
    v = F.col("v")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    # the length, by way of the largest component: its square may be beyond the range of doubles
    norm = F.element_at(F.transform(F.array(F.array_max(F.transform("v", lambda x: F.abs(x)))), lambda m: m * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / m) * (x / m)))), 1)
    sizes = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "d").first()
    dim, n, top = (sizes["d"], sizes["n"], min(sizes["top"], np.finfo(float).max)) if sizes else (0, 0, 0.0)
    top, power = (float(x) for x in np.frexp(top))
    top, power = top * (1 + 1e-12), int(power)  # of the vectors divided by 2**power
    clean = clean.where(F.size("v") == dim)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * query_rows)))

    def pack(table: pa.Table) -> pa.Table:
        flat = np.ldexp(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), -power).astype("<f8")
        key = table.schema.names[0]
        return pa.table({key: table[key].slice(0, 1), "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "vs": pa.array([flat.tobytes()], pa.binary())})

    shard = clean.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v").groupBy("shard").applyInArrow(pack, "shard long, ids binary, vs binary")
    query = clean.where(F.col("id") % every == 0).select(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).alias("block"), "id", "v").groupBy("block").applyInArrow(pack, "block long, ids binary, vs binary")
    # a task is some shards and some query blocks: packed sides travel, a shard once per group of blocks
    groups = -(-blocks // GROUP_BLOCKS)
    many = max(1, min(group_shards, shards * groups // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    sides = -(-shards // many)
    unit = lambda s, g: (F.col(s) * groups + F.col(g)).alias("unit")
    here = shard.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("s", F.floor(F.col("shard") / many)).select(unit("s", "g"), "ids", "vs")
    asked = query.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).withColumn("g", F.floor(F.col("block") / GROUP_BLOCKS))
    asked = asked.select(unit("s", "g"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        for raw_ids, raw in zip(y["q_ids"].to_pylist(), y["q_vs"].to_pylist(), strict=True) if x.num_rows else ():
            q_ids, q = np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw, "<f8").reshape(-1, dim)
            found: list = [[], [], []]
            for ids, vs in zip(x["ids"], x["vs"], strict=True):
                for i, near, score in search_shard(np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(vs.as_py(), "<f8").reshape(-1, dim), q_ids, q, top, k, slack, leaf_rows):
                    for column, value in zip(found, (np.full(len(near), i), near, score), strict=True):
                        column.append(value)
            if found[0]:
                i, near, score = map(np.concatenate, found)
                order = np.lexsort((near, -score, i))
                first = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])
                best = order[np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k]
                for column, value in zip(out, (q_ids[i[best]], near[best], score[best]), strict=True):
                    column.append(value)
        cat = lambda a, t: pa.array(np.concatenate(a).astype(t) if a else np.zeros(0, t))
        return pa.table([cat(out[0], np.int64), cat(out[1], np.int64), cat(out[2], np.float64)], names=["query_id", "vec_id", "score"])

    near = here.groupBy("unit").cogroup(asked.groupBy("unit")).applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    half, rest = (float(np.ldexp(1.0, n)) for n in (power // 2, power - power // 2))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (F.col("score") * half * rest * half * rest).alias("score"))
