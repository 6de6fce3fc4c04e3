"""Cross-entropy difference of two matched n-gram models.

Target and background are bigram models of one form over one vocabulary, all words of both; each counts every text of its
side. Texts are dealt to blocks; a block asks for the counts of its distinct words and bigrams in packed, sorted
form, parts of the key space add them up over all blocks, and the answers go back to the block, which scores its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, mix, pack_sorted, planes, sums, text_slices, unpack_sorted, unplanes, word_hashes, written

#: Bytes of text per block; pseudo-counts of the unigram in a bigram's context and of each word in the unigram.
BLOCK, CONTEXT, ADD = 8_000_000, 5.0, 0.5
#: Bits of a key. A key is the hash of a word, or of a word after another one.
BITS = 48


def _keys(table: pa.Table):
    """Per block, rows in the order of their ids: word keys, bigram keys (of each word after the one before it, or after
    the text's start), row offsets."""
    words, pairs, counts = [], [], []
    for _, _, data, offsets in text_slices(table["text"].combine_chunks()):
        h, first = word_hashes(data, offsets)
        before = np.r_[np.zeros(min(1, len(h)), np.uint64), h[:-1]]
        before[first[:-1][np.diff(first) > 0]] = 0
        words.append(mix(h))
        pairs.append(mix(h * np.uint64(0x9FB21C651E98DF25) + mix(before + np.uint64(1))))
        counts.append(np.diff(first))
    cut = np.uint64(64 - BITS)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    offsets = np.r_[0, np.cumsum(cat(counts, np.int64))]
    return cat(words, np.uint64) >> cut, cat(pairs, np.uint64) >> cut, offsets


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.lexsort((np.arange(table.num_rows), table["id"].fill_null(np.iinfo(np.int64).min).to_numpy()))))


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, context: float = CONTEXT, add: float = ADD) -> DataFrame:
    """(id_col, n_tokens, target_loss, background_loss, score), one row per row of docs.

    targets (id_col) names the target documents; all others are background. Losses are nats per token: bigrams with the
    word's own frequency as prior (weight `context`), which has `add` on every word of the shared vocabulary and one word more. A
    text's own counts are taken out of its side's model before it is scored, so membership alone moves nothing.
    score = target_loss - background_loss, the mean of the per-token differences: the lower, the more like the target. Words
    are [^\\x20\\x09-\\x0D]+ with A-Z lowered. Null, empty and blank texts have no token and null losses. Repeated rows are
    scored each; ids of targets that are unknown or null count for nothing; a null id is background. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts = max(1, -(-size // block))
    bucket = lambda text: F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.xxhash64(text))), F.lit(blocks)).alias("block")
    marks = targets.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    # texts and marks meet in one exchange by block; rows without an id are dealt by their text
    base = rows.select(bucket(F.col("text")), "id", "text", F.lit(False).alias("mark")).union(marks.select(bucket(F.lit(None).cast("string")), "id", F.lit(None).cast("string"), F.lit(True)))

    def split(table: pa.Table):
        mark = table["mark"].to_numpy()
        texts = _sorted(table.filter(pa.array(~mark)))
        chosen = np.isin(texts["id"].fill_null(np.iinfo(np.int64).min).to_numpy(), table.filter(pa.array(mark))["id"].to_numpy())
        return texts, chosen

    def ask(table: pa.Table) -> pa.Table:
        texts, chosen = split(table)
        words, pairs, offsets = _keys(texts)
        side = np.repeat(chosen, np.diff(offsets))
        keys, inverse = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        both = np.r_[side, side]
        t = np.bincount(inverse, weights=both, minlength=len(keys)).astype(np.int64)
        b = np.bincount(inverse, weights=~both, minlength=len(keys)).astype(np.int64)
        word = np.zeros(len(keys), np.int64)
        word[inverse[: len(words)]] = 1
        edges = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.float64) * (2.0**BITS / parts)).astype(np.uint64))
        edges[-1] = len(keys)
        out = [(p, pack_sorted(keys[x:y]), planes(t[x:y], _width(t[x:y])), planes(b[x:y], _width(b[x:y])), planes(word[x:y], 1)) for p, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
        own = table["block"][0].as_py()
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([own] * len(out), pa.int64()), *(binary_array(list(c)) for c in cols[1:])], names=["part", "block", "keys", "t", "b", "word"])

    asked = base.groupBy("block").applyInArrow(ask, "part long, block long, keys binary, t binary, b binary, word binary")

    def tell(table: pa.Table) -> pa.Table:
        lists = {c: [f(x) for x in table[c].to_pylist()] for c, f in (("keys", unpack_sorted), ("t", unplanes), ("b", unplanes), ("word", unplanes))}
        keys, inverse = np.unique(np.concatenate(lists["keys"]), return_inverse=True)
        t, b = (np.bincount(inverse, weights=np.concatenate(lists[c]), minlength=len(keys)).astype(np.int64) for c in "tb")
        word = np.zeros(len(keys), bool)
        word[inverse[np.concatenate(lists["word"]) > 0]] = True
        edges = np.r_[0, np.cumsum([len(x) for x in lists["keys"]])]
        answer = [(planes(t[i], _width(t[i])), planes(b[i], _width(b[i]))) for i in (inverse[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))]
        total = [[int(word.sum()), int(t[word].sum()), int(b[word].sum())]] + [[0, 0, 0]] * (len(answer) - 1)
        return pa.table([table["block"], table["part"], binary_array([a for a, _ in answer]), binary_array([b for _, b in answer]), pa.array(total, pa.list_(pa.int64()))], names=["block", "part", "t", "b", "total"])

    told = written(asked.groupBy("part").applyInArrow(tell, "block long, part long, t binary, b binary, total array<long>"))
    v, n_t, n_b = (x or 0 for x in told.agg(*(F.sum(F.col("total")[i]) for i in range(3))).first())

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, chosen = split(table) if table.num_rows else (table, np.zeros(0, bool))
        if not texts.num_rows:
            none = pa.array([], pa.float64())
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), none, none, none], names=[id_col, "n_tokens", "target_loss", "background_loss", "score"])
        words, pairs, offsets = _keys(texts)
        n = np.diff(offsets)
        rows = np.repeat(np.arange(len(n)), n)
        keys, inverse = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        answers = answers.sort_by("part")
        side = np.repeat(chosen, n)
        wi, pi = inverse[: len(words)], inverse[len(words) :]
        start = np.zeros(len(rows), bool)
        start[offsets[:-1][n > 0]] = True
        # the count of a context is its word's, or that of text starts
        ci = np.r_[wi[:1], wi[:-1]]

        def own(index: np.ndarray) -> np.ndarray:
            """How often each token's key is in its own text."""
            code = rows.astype(np.int64) * (len(keys) + 1) + index
            _, back, count = np.unique(code, return_inverse=True, return_counts=True)
            return count[back]

        own_w, own_p = own(wi), own(pi)
        own_c = np.r_[own_w[:1], own_w[:-1]]
        losses = []
        for name, mine, total in (("t", side, n_t), ("b", ~side, n_b)):
            count = np.concatenate([unplanes(x) for x in answers[name].to_pylist()]).astype(np.float64) if answers.num_rows else np.zeros(0)
            out = mine.astype(np.float64)
            cw, cp, cc = count[wi] - out * own_w, count[pi] - out * own_p, count[ci] - out * own_c
            n_all = total - out * np.repeat(n, n)
            unigram = (cw + add) / (n_all + add * (v + 1))
            # a text's first word has no context: its unigram is its probability
            p = np.where(start, unigram, (cp + context * unigram) / (np.where(start, 0.0, cc) + context))
            losses.append(sums(-np.log(p), offsets) / np.maximum(n, 1))
        none = n == 0
        cols = [pa.array(x, mask=none) for x in (losses[0], losses[1], losses[0] - losses[1])]
        return pa.table([texts["id"], pa.array(n), *cols], names=[id_col, "n_tokens", "target_loss", "background_loss", "score"])

    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"`{id_col}` long, n_tokens long, target_loss double, background_loss double, score double")
