"""Whitening, periodic runs and SimHash against brute force: whole tables, and small ones with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import queries as llm
from stratalog.llm.components import connected_components
from stratalog.llm.runs import periodic_runs, repeated_tails, runs_of_rows
from stratalog.llm.simhash import BKTrees, block_masks, choose_blocks, linked, simhash_components
from stratalog.llm.whiten import block_state, decomposed, grid, merged, whiten

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
VECTORS = "vec_id long, embedding array<float>, component int, x string"


# whitening


def brute_whitening(vectors, k=32):
    """{position: (deviation, whitened)}, shares and n, by the eigenvectors of the covariance; vectors that do not count are None."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    centred = np.array([[(n * r[i] - s[i]) / n for i in range(d)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, centred @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def check_whitening(rows, vectors):
    """rows of the operator for vectors {id: vector}, each id once."""
    ids = sorted(vectors)
    deviation, w, share = brute_whitening([vectors[i] for i in ids])
    k = w.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k and {r["n"] for r in rows} == {len(ids)} and len({r["identity_error"] for r in rows}) == 1
    assert rows[0]["identity_error"] < 1e-9
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w * sign).max() < 1e-7
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    assert np.allclose([got[ids[0], c + 1]["explained"] for c in range(k)], share, rtol=1e-9)


def test_whitening_of_the_whole_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(llm.op11_embedding_whitening(spark, SF).collect(), {r["vec_id"]: r["embedding"] for r in e})


def test_whitening_of_odd_rows(spark):
    r = random.Random(2)
    good = {i: [r.gauss(0, 1 + j) for j in range(5)] for i in range(40)}
    good |= {i: good[7] for i in range(40, 60)}  # copies
    good = {i: np.float32(v).tolist() for i, v in good.items()}
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [1.0, 2.0, float("inf"), 0.0, 0.0]), (104, [1.0]), (105, []), (106, [3e38] * 5)]
    table = spark.createDataFrame([(i, v, 3, "clash") for i, v in [*good.items(), *odd]], VECTORS).repartition(7)
    check_whitening(whiten(grid(table)).collect(), good)
    repeated = whiten(grid(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (1, [2.0, 0.0], 0, ""), (None, [0.0, 0.0], 0, "")], VECTORS))).collect()
    assert sorted(str(x["vec_id"]) for x in repeated) == ["1"] * 4 + ["None"] * 2 and {x["n"] for x in repeated} == {3}


def test_whitening_without_variance(spark):
    table = lambda *v: grid(spark.createDataFrame([(i, x, 0, "") for i, x in enumerate(v)], VECTORS))
    assert whiten(table()).collect() == [] and whiten(table([])).collect() == []
    for rows in (whiten(table([1.0, 2.0])).collect(), whiten(table([1.0, 2.0], [1.0, 2.0])).collect()):
        assert all((x["deviation"], x["whitened"], x["explained"], x["identity_error"]) == (0, 0.0, 0.0, 0.0) for x in rows)
    flat = whiten(table([0.0, 1.0, 5.0], [1.0, 1.0, 7.0], [2.0, 1.0, 9.0]), components=3).collect()  # one direction only
    assert [round(x["explained"], 9) for x in flat[:3]] == [1.0, 0.0, 0.0] and flat[1]["whitened"] == flat[2]["whitened"] == 0.0
    assert flat[0]["identity_error"] < 1e-9
    far = [v["deviation"] for v in whiten(table([2.0**40], [-(2.0**40)])).collect()]
    assert far == [None, None]  # beyond a long


@pytest.mark.parametrize("cut", [(1, 1, 1), (3, 10, 40), (100, 1, 2)])
def test_states_merge_without_loss(cut):
    x = np.random.default_rng(5).integers(-(10**6), 10**6, (sum(cut), 6)) + 10**9
    state, at = None, 0
    for n in cut:
        block = block_state(x[at : at + n])
        state = merged(state, block) if state else (block[0], block[1], decomposed(block[2]))
        at += n
    near = x - x.mean(axis=0)
    assert state[0] == len(x) and state[1] == x.sum(axis=0).tolist() and len(state[2]) <= max(6, sum(cut[:1]))
    assert np.allclose(state[2].T @ state[2], near.T @ near, rtol=1e-10)


# runs


def brute_runs(words, min_length=6, min_exponent=4):
    out, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_length, min_exponent * q):
                out.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, many):
    r = random.Random(seed)
    fibonacci = ["b", "a"]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ("", "a", "a" * 60, "ab" * 40, "aab" * 20 + "aab"[:2], fibonacci[-1], "".join(str(i.bit_count() % 2) for i in range(130)))
    for _ in range(many):
        unit = "".join(r.choice("ab") for _ in range(r.randint(1, 7)))
        t = "".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 25))) + unit * r.randint(1, 9)
        t += "".join(r.choice("abcdef") for _ in range(r.randint(0, 9))) + unit * r.randint(0, 7)
        yield t * r.choice((1, 1, 2, 3, 5))


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (6, 3), (9, 2)])
def test_runs_of_many_rows(length, exponent):
    for part in range(12):
        rows = list(sequences(part, 30))
        random.Random(part).shuffle(rows)
        edges = np.r_[0, np.cumsum([len(t) for t in rows])].astype(np.int64)
        symbols = np.array([xxhash.xxh64_intdigest(f"{i} {c}") for i, t in enumerate(rows) for c in t], np.uint64)
        got = sorted(zip(*(a.tolist() for a in runs_of_rows(symbols, edges, length, exponent)), strict=True))
        assert got == sorted((s + edges[i], s + n + edges[i], q) for i, t in enumerate(rows) for s, n, q in brute_runs(t, length, exponent))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_texts(spark):
    rows = [" ".join(t) for t in sequences(77, 40)] + [None, "", " \t\n", "  x  ", "é é é é é é é é", "a\x0ba\x0ca\ra\na\ta a", "no break " * 9, "日本 語 " * 5, "x" * 30000]
    rows += ["once " + " ".join(f"w{i % 997}" for i in range(6000)), "go " * 20000]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(rows)] + [(None, rows[3], "", 0), (0, "b b b b b b", "", 0)], "doc_id long, text string, runs string, n_words int").repartition(3)
    got = sorted(((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        w = WORDS.findall(r["text"] or "")
        runs = [(0, 20000, 1)] if len(w) == 20000 else brute_runs(w)
        want.append((str(r["doc_id"]), len(w), runs, brute_collapsed(w, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0 and repeated_tails(docs.limit(0)).count() == 0


def test_a_text_of_twelve_megabytes(spark):
    body = " ".join(f"w{i * i % 100_003}" for i in range(1_700_000))
    docs = spark.createDataFrame([(1, body + " tick tock" * 50)], "doc_id long, text string")
    row = periodic_runs(docs).first()
    words = (body + " tick tock" * 50).split(" ")
    assert row["n_words"] == len(words) and [tuple(r) for r in row["runs"]][-1] == (len(words) - 100, 100, 2)
    one = simhash_components(docs).first()
    assert one["component_id"] == 1 and int(one["fingerprint"], 16) > 0


def test_repeated_tails_of_the_whole_table(spark):
    made = {r["doc_id"]: r["text"] for r in repeated_tails(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    tailed = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = WORDS.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert made[r["doc_id"]] == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
            tailed += 1
        else:
            assert made[r["doc_id"]] == r["text"]
    assert tailed > 5
    odd = spark.createDataFrame([(None, "a b"), (23, None), (23, " \n"), (23, "a b c d e f g h")], "doc_id long, text string")
    assert len(repeated_tails(odd).collect()) == 4


def test_runs_of_the_whole_table(spark):
    """op12 against brute force (its SQL is tested with the others)."""
    got = {r["doc_id"]: r for r in llm.op12_periodic_runs(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = 0
    for r in repeated_tails(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        w = WORDS.findall(r["text"] or "")
        if len(w) > 3000:
            continue  # brute force is quadratic
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        mine = got[r["doc_id"]]
        assert (mine["n_runs"], mine["runs_sha256"], mine["collapsed_sha256"]) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(w, runs)))
        assert tuple(mine[c] for c in ("start", "length", "period", "exponent_milli")) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        some += bool(runs)
    assert some > 5


# SimHash


def brute_fingerprint(text, k=4):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps, radius=4):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i:] ^ f[i]) <= radius).tolist():
            a, b = top(i), top(i + j)
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_simhash_of_the_whole_table(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, brute_labels(fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in llm.op13_simhash_near_dedup(spark, sf).collect()} == want


def test_simhash_of_odd_texts(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n", "a", "A", "a b c", "a b c d", "A  b\tC d", base, base + " more", base.upper(), "É É É É", "é é é é", " ", "x" * 20000]
    docs = spark.createDataFrame([(i + 10, t, "clash", 1) for i, t in enumerate(texts)] + [(3, base, "", 0), (3, "quite another one", "", 0), (None, "a", "", 0), (None, "alone with no id", "", 0)], "doc_id long, text string, fp string, component_id int").repartition(3)
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_labels(fps)
    least = {c: min((r["doc_id"] for r, x in zip(rows, label, strict=True) if x == c and r["doc_id"] is not None), default=None) for c in label}
    want = sorted(((str(r["doc_id"]), f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, label, strict=True)), key=repr)
    assert sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash_components(docs).collect()), key=repr) == want
    assert simhash_components(docs.limit(0)).count() == 0


def clustered(seed, centres=12, each=60, flips=9):
    r = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            f = c
            for _ in range(r.randint(0, flips)):
                f ^= 1 << r.randrange(64)
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("seed, tree, shard", [(1, 4096, 256), (2, 8, 1 << 40), (3, 8, 1), (4, 50, 1 << 40)])
def test_links_join_what_is_near(spark, seed, tree, shard):
    """Shards of one tree and of many pieces, five to twelve blocks."""
    fps = clustered(seed) if seed < 4 else clustered(seed, 1, 1500, 14)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = linked(nodes, 4, tree, shard, 500)
    of = {r["id"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
    got, want = {}, {}
    for f, c in zip(fps, brute_labels(fps), strict=True):
        got.setdefault(of.get(f, f - (1 << 64) if f >> 63 else f), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(fps)


def test_trees_find_all_within_the_radius():
    fps = np.array(clustered(9), np.uint64)
    tree = np.arange(len(fps)) * 5 // len(fps)
    trees = BKTrees(tree, fps)
    for radius in (0, 3, 6):
        got = sorted((int(a), int(b)) for q, m in trees.search(tree, fps, radius) for a, b in zip(q, m, strict=True))
        assert got == [(i, j) for i in range(len(fps)) for j in range(len(fps)) if tree[i] == tree[j] and int(fps[i] ^ fps[j]).bit_count() <= radius]


def test_blocks_lose_no_pair():
    assert choose_blocks(10**5, 4) == 5 < choose_blocks(10**8, 4)
    r = random.Random(4)
    for blocks in (5, 6, 8):
        masks = block_masks(blocks, 4)
        for _ in range(300):
            flip = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            assert any(not flip & m for m in masks)


def test_hot_fingerprints(spark):
    """A third of all rows share one text; another third are near copies of one another."""
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = ["same words all over again and again"] * 400
    for i in range(400):
        t = list(base)
        t[i % 400] = "edit"
        texts.append(" ".join(t))
    texts += [" ".join(r.choice("abcdefghij") * 3 for _ in range(9)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fps = [brute_fingerprint(t) for t in texts]
    want = dict(enumerate(brute_labels(fps)))
    assert {x["doc_id"]: x["component_id"] for x in simhash_components(docs, tree_rows=20, task_rows=300).withColumn("n", F.lit(0)).collect()} == want
