"""Periodic runs of words, by longest previous factors.

Texts are whole in their task, many at a time in one array of words. Prefix doubling sorts their suffixes and keeps, for every
power of two, the rank of the factor that starts at each word, so that common extensions to either side cost a few lookups. From
the suffix array and the LCP array comes each word's longest previous factor, from these the Lempel-Ziv blocks of each text. A run either touches a
block's edge, and is found there by extending both ways from the edge and a place one period away (Main), or lies strictly inside a
block and is copied from the block's earlier occurrence, whose runs are looked up by their start.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_words, mix, text_slices, word_hashes


def factor_ranks(symbols: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all rows and, for k = 0, 1, ..., the ranks of the factors of 2^k symbols, equal for equal factors. Symbols of
    different rows differ; row_end[i] is the end of i's row. A factor that its row cuts short equals no other one. Ranks have one more
    entry, -1; levels whose factors are all different are left out."""
    n = len(symbols)
    order = np.argsort(symbols)
    ahead = symbols[order]
    slots, act, key = np.arange(n), order.copy(), ahead
    rank, step, levels = np.full(n + 1, -1, np.int32), 1, []
    while True:
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        rank[act] = np.repeat(slots[first], np.diff(np.r_[first, len(act)]))
        order[slots] = act
        many = ~(head & np.r_[head[1:], True]) if len(head) else head  # groups of more than one
        slots, act = slots[many], act[many]
        if not len(act):
            return order, levels
        levels.append(rank.copy())
        then = act + step
        inside = then < row_end[act]
        key = rank[act].astype(np.int64) * (n + 1) + np.where(inside, rank[np.where(inside, then, n)], -1) + 1
        turn = np.argsort(key)
        act, key, step = act[turn], key[turn], 2 * step


def common_extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from i and j on are equal (back: up to and with i and j), i < j. Places may be -1 (back) or a row's end: no symbol is equal."""

    def same(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not back:
            return levels[k][a] == levels[k][b]
        a, b = a - (1 << k) + 1, b - (1 << k) + 1
        return (a >= 0) & (levels[k][a] == levels[k][b])

    out, alive, live = np.zeros(len(i), np.int64), [], np.arange(len(i))
    for k in range(len(levels)):
        live = live[same(k, i[live], j[live])]
        if not len(live):
            break
        alive.append(live)
    for k in range(len(alive) - 1, -1, -1):
        at = alive[k]
        off = -out[at] if back else out[at]
        out[at[same(k, i[at] + off, j[at] + off)]] += 1 << k
    return out


def longest_previous_factors(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per place the length of the longest factor from it on that also starts earlier in its row, and where (-1: none)."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    a, b = order[:-1], order[1:]
    lcp[1:n] = common_extension(levels, np.minimum(a, b), np.maximum(a, b))
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for side in (-1, 1):
        # the nearest slot to this side whose suffix starts earlier, with the least LCP on the way: pointers jump over larger ones
        to = np.arange(n) + side
        low = (lcp[:n] if side < 0 else lcp[1:]).copy()
        low[(to < 0) | (to >= n)] = 0
        act = np.flatnonzero(low > 0)
        while len(act := act[order[to[act]] > order[act]]):
            over = to[act]
            low[act], to[act] = np.minimum(low[act], low[over]), to[over]
            act = act[low[act] > 0]
        found = np.flatnonzero(low > 0)
        place = order[found]
        better = low[found] > best[place]
        best[place[better]], source[place[better]] = low[found[better]], order[to[found[better]]]
    return best, source


def runs_of_rows(symbols: np.ndarray, edges: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of rows edges[r]:edges[r + 1] of symbols, ascending, of at least min_length symbols and min_exponent
    (2 or more) periods. Symbols of different rows differ."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    rows = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    begin, end = edges[rows], edges[rows + 1]
    order, levels = factor_ranks(symbols, end)
    if not levels:
        return none, none, none
    longest, source = longest_previous_factors(order, levels)
    del order
    onward, at, starts = (np.arange(n) + np.maximum(longest, 1)).tolist(), 0, []
    while at < n:
        starts.append(at)
        at = onward[at]
    del onward
    block = np.array(starts)
    stop = np.r_[block[1:], n]
    size = stop - block

    # pairs (c - p, c) to extend from: c - p a block's start and c in the block or its end; c a block's end and c - p up to the lengths of that block and the next one before it
    right_x, right_c = np.repeat(block, size), np.arange(1, n + 1)
    after = np.r_[np.where(rows[block[1:]] == rows[block[:-1]], size[1:], 0), 0]
    reach = np.minimum(size + after, (stop - begin[block]) + 1) - 1
    reach = np.minimum(reach, (end[block] - begin[block]) // min_exponent)
    left_c = np.repeat(stop, reach)
    left_x = left_c - 1 - (np.arange(len(left_c)) - np.repeat(np.cumsum(reach) - reach, reach))
    x, c = np.r_[right_x, left_x], np.r_[right_c, left_c]
    del right_x, right_c, left_c, left_x
    need = np.maximum(min_length - (c - x), (min_exponent - 1) * (c - x))  # both extensions together
    for k, rank in enumerate(levels):
        reach = 1 << k  # the longer extension has so many symbols at least, where need is 2 * reach - 1 or more
        before = np.maximum(x - reach, -1)
        keep = (need < 2 * reach - 1) | (rank[x] == rank[c]) | ((before >= 0) & (rank[before] == rank[c - reach]))
        x, c, need = x[keep], c[keep], need[keep]
    reach = 1 << len(levels)
    keep = need < 2 * reach - 1
    x, c = x[keep], c[keep]
    s = x - common_extension(levels, x - 1, c - 1, back=True)
    e = c + common_extension(levels, x, c)
    p = c - x
    keep = (e - s >= min_length) & (e - s >= min_exponent * p)
    s, e, p = s[keep], e[keep], p[keep]
    turn = np.lexsort((p, e, s))
    s, e, p = s[turn], e[turn], p[turn]
    if len(s):
        keep = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]  # the smallest period of each stretch
        s, e, p = s[keep], e[keep], p[keep]
        live = np.zeros(len(edges) - 1, bool)
        live[rows[s]] = True
        wide = (size >= min_length + 2) & live[rows[block]] & (source[block] >= 0)
        cs, ce, cp = _copied(s.tolist(), e.tolist(), p.tolist(), block[wide].tolist(), stop[wide].tolist(), source[block[wide]].tolist())
        s, e, p = (np.concatenate([a, np.array(b, np.int64)]) for a, b in ((s, cs), (e, ce), (p, cp)))
        turn = np.lexsort((p, s))
        s, e, p = s[turn], e[turn], p[turn]
    return s, e, p


def _copied(starts: list, ends: list, periods: list, block: list, stop: list, source: list) -> tuple[list, list, list]:
    """The runs strictly inside blocks, from left to right: those strictly inside the block's earlier occurrence, moved. A block may overlap its
    source; copies are appended in the order of their starts, so they can be sources themselves."""
    cs: list[int] = []
    ce: list[int] = []
    cp: list[int] = []
    for b, e, src in zip(block, stop, source, strict=True):
        limit, shift = src + e - b, b - src
        i, k = bisect_right(starts, src), bisect_right(cs, src)
        top = bisect_left(starts, limit)
        while True:
            if i < top and (k >= len(cs) or starts[i] <= cs[k]):
                s, t, p = starts[i], ends[i], periods[i]
                i += 1
            elif k < len(cs) and cs[k] < limit:
                s, t, p = cs[k], ce[k], cp[k]
                k += 1
            else:
                break
            if t < limit:
                cs.append(s + shift)
                ce.append(t + shift)
                cp.append(p)
    return cs, ce, cp


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(id_col, n_words long, runs array<struct<start, length, period: long>>, collapsed string), one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch of words with smallest period q, of at least min_length words and
    min_exponent (2 or more) periods, that no neighbouring word extends keeping the period; runs are sorted by start, then period. collapsed: the words that no
    run contains after its first q words, joined by one space. Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated
    and null ids are carried, a result for each row; an empty table gives none; other columns are not read, so their names cannot clash. A text is worked off whole in one task, in memory of
    about 300 bytes a word; nothing is shuffled. Words are compared by 64-bit hashes."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in text_slices(batch.column(1)):
                hashes, first = word_hashes(data, offsets, lower=False)
                n = np.diff(first)
                rows = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                s, e, p = runs_of_rows(mix(hashes + rows * np.uint64(0x9E3779B97F4A7C15)), first, min_length, min_exponent)
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, s + p, 1)
                np.add.at(cover, e, -1)
                drop = np.cumsum(cover)[:-1] > 0
                edge = np.searchsorted(s, first).astype(np.int32)
                begin = first[np.searchsorted(first, s, "right") - 1] if len(s) else s
                spans = pa.StructArray.from_arrays([pa.array(s - begin), pa.array(e - s), pa.array(p)], fields=list(RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(n), pa.ListArray.from_arrays(pa.array(edge), spans), joined_words(data, offsets, first, drop)], [id_col, "n_words", "runs", "collapsed"]
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): the texts, of which a tenth, by the CRC-32 of the id, become periodic from some word on: with h that checksum, g = floor(h / 10),
    n words, a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)), each word i >= a becomes word a + (i - a) mod p. These texts
    have their words joined by one space. Null texts and ids change nothing."""
    h = F.crc32(F.col("i").cast("string").cast("binary"))
    split = F.when((F.col("h") % 10 == 0) & F.col("t").isNotNull(), F.filter(F.split("t", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("h", h)
    rows = rows.withColumn("w", split).withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long"))).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int"))), " ")
    return rows.select(F.col("i").alias(id_col), F.when(F.col("n").isNotNull(), made).otherwise(F.col("t")).alias("text"))
