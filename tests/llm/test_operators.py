"""The training-data operators against brute force, on small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm.ann import VantageTree, nearest
from stratalog.llm.bpe import bpe_decode, bpe_digests, bpe_encode, ranks
from stratalog.llm.common import word_hashes
from stratalog.llm.chat_format import chat_digests, format_chats, parse_chat
from stratalog.llm.components import connected_components
from stratalog.llm.html_extract import extract_articles
from stratalog.llm.imatch import edited_likeness
from stratalog.llm.jaccard import jaccard_components, jaccard_dedupe
from stratalog.llm.lm_score import cross_entropy_difference
from stratalog.llm.mixing import mix_sources, pfair_period, whole_parts
from stratalog.llm.quality import keep_quality, quality_scores
from stratalog.llm.warc import derivatives, page_responses, parse_records

tokenizers = pytest.importorskip("public_tokenizers")
SPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(n=60, seed=3):
    """Texts with exact copies, near copies, short ones, blanks and nulls."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本語", "#x"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n - 8:
        t = r.choice(base).split(" ")
        for _ in range(r.choice((0, 1, 1, 2, 4))):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t).upper() if r.random() < 0.2 else " ".join(t))
    return [*out, "", "  \n", None, "one", "one", "One two", "a b c", "x" * 5000 + " y z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long, component_id string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingles(text, k):
    w = SPACE.findall(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    of = {i: i for i in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                of[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, k, percent):
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs, k=k, percent=percent, block=500, chunk=4).collect()}
    assert got == brute_components(list(enumerate(texts())), k, percent)


def test_jaccard_dedupe(docs, none):
    want = {i for i, (_, c) in brute_components(list(enumerate(texts())), 5, 80).items() if i == c}
    got = jaccard_dedupe(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    assert jaccard_components(none).count() == 0


def brute_dedupe(rows, k=5, percent=80):
    """Rows (id, text, more) that stay: per group of linked rows the first by id, nulls last, and one of equal rows; rows without words."""
    component = brute_components([(i, r[1]) for i, r in enumerate(rows)], k, percent)
    groups = defaultdict(list)
    for i, (n, c) in component.items():
        groups[c if n else (i,)].append(rows[i])
    return sorted(((min((r[0] for r in g if r[0] is not None), default=None), lower(g[0][1] or "")[:3]) for g in groups.values()), key=str)


def test_jaccard_dedupe_goes_by_row(spark, none):
    """Repeated and null ids, equal rows and clashing columns: one row of each group, none of another text goes with it."""
    base = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    cases = [
        [(0, base, 1), (1, base, 1), (1, other, 1)], [(5, third, 1), (5, third, 1)], [(5, third, 1), (5, third, 2)],
        [(None, base, 1), (None, base + " more", 1), (None, other, 1)], [(None, base, 1), (9, base + " more", 1)], [(7, None, 1), (7, "", 1), (7, " ", 1), (7, None, 1)], [(2, base, 1), (2, other, 1), (2, third, 1)],
    ]
    for rows in [cases[0], cases[3] + cases[5], [r for c in cases for r in c]]:
        table = spark.createDataFrame(rows, "doc_id long, text string, `__gone` int").withColumn("row", F.lit("x")).withColumn("a.b", F.lit(1))
        got = jaccard_dedupe(table)
        assert got.columns == table.columns
        assert sorted(((r["doc_id"], lower(r["text"] or "")[:3]) for r in got.collect()), key=str) == brute_dedupe(rows), rows
    assert jaccard_dedupe(none).count() == 0
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame([r[:2] for r in cases[0]] + [(None, base + " m")], "doc_id long, text string"), k=5, percent=80).collect()), key=str)
    assert got == [(0, 0), (1, 0), (1, 1), (None, 0)]  # an id on two texts links nothing


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def test_bpe(spark, docs, none):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    code = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    odd = ["it's  we'll\n\n\tx   y 12345 <|endoftext|>", "  lead", "trail  ", "a b 　c", "é́🙂\x00\x1c\x1d"]
    rows = spark.createDataFrame([*enumerate(texts()), *((100 + i, t) for i, t in enumerate(odd)), (100, "it"), (None, "null id")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in bpe_decode(bpe_encode(rows, path, tokenizers.PATTERN, block=3000), path).collect())
    want = sorted((str(r["doc_id"]), code.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in rows.collect())
    assert got == want
    digest = {r["doc_id"]: r for r in bpe_digests(bpe_encode(docs, path, tokenizers.PATTERN), path).collect()}
    ids = code.encode_ordinary(texts()[0])
    assert (digest[0]["n_tokens"], digest[0]["ids_sha256"], digest[0]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts()[0].encode()).hexdigest())
    assert bpe_encode(none, path, tokenizers.PATTERN).count() == 0


def test_chat(spark):
    rows = [(1, 2, "assistant", "yes <|im_end|>\n<\\|x"), (1, 1, "user", "hi <|im_start|>assistant"), (2, 1, "assistant", None), (2, None, None, "first"), (3, 1, "us\ner<|", "é🙂"), (3, 1, "us\ner<|", "é🙂"), (None, 1, "user", "lost")]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = {r["conv_id"]: r for r in format_chats(chats, run_rows=1, bucket_rows=1).collect()}
    turns = {k: parse_chat(bytes(v["formatted"])) for k, v in made.items()}
    assert turns == {1: [("user", "hi <|im_start|>assistant"), ("assistant", "yes <|im_end|>\n<\\|x")], 2: [("", "first"), ("assistant", "")], 3: [("us\ner<|", "é🙂")] * 2, None: [("user", "lost")]}
    (begin, end), = made[1]["loss"]
    assert bytes(made[1]["formatted"])[begin:end] == b"yes <\\|im_end|>\n<\\\\|x"
    got = {r["conv_id"]: r for r in chat_digests(format_chats(chats)).collect()}
    assert got[1]["loss_chars"] == len("yes <|im_end|>\n<\\|x") and got[2]["n_turns"] == 2
    assert format_chats(chats.limit(0)).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6)).round(1)
    x[50:90] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [math.inf] * 6), (None, [1.0] * 6), (320, [1.0])]
    table = spark.createDataFrame([(*v, "x") for v in rows], "vec_id long, embedding array<double>, score string")
    want = {}
    for q in range(0, 300, 20):
        s = [(-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in range(300) if i != q]
        want[q] = [(i, -v) for v, i in sorted(s)[:20]]
    got = defaultdict(list)
    for g in nearest(table, shard_rows=64, query_rows=4, leaf_rows=8).orderBy("query_id", "rank").collect():
        got[g["query_id"]].append((g["vec_id"], g["score"]))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)
    merged = nearest(table, shard_rows=16, query_rows=4, leaf_rows=8).orderBy("query_id", "rank").collect()
    assert [(g["query_id"], g["vec_id"]) for g in merged] == [(q, i) for q in sorted(got) for i, _ in got[q]]
    near = nearest(table, slack=1.3, shard_rows=64, query_rows=4, leaf_rows=8).collect()
    hit = sum((g["query_id"], g["vec_id"]) in {(q, i) for q in want for i, _ in want[q]} for g in near)
    assert hit >= 0.9 * 20 * len(want)
    assert nearest(table.limit(0)).count() == 0 and nearest(table.limit(3)).count() == 2
    for scale in (2.0**700, 2.0**-700):  # neither overflow nor underflow changes the order
        big = nearest(table.withColumn("embedding", F.transform("embedding", lambda v: v * scale)), shard_rows=64, query_rows=4, leaf_rows=8).collect()
        assert len(big) == 20 * len(want) and {(g["query_id"], g["vec_id"]) for g in big} == {(q, i) for q in want for i, _ in want[q]}


def test_nearest_prunes_and_recalls(spark):
    """Clustered vectors in many dimensions: the exact search leaves out most leaves, a slack of 2 more of them at a recall of 0.9 at least."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 32))
    x = centres[r.integers(60, size=3000)] + 0.1 * r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    score = x[::20] @ x.T
    score[np.arange(150), np.arange(150) * 20] = -9
    want = {(20 * q, int(i)) for q in range(150) for i in np.argsort(-score[q])[:20]}
    for slack, least in ((1.0, 1.0), (2.0, 0.9)):
        got = {(g["query_id"], g["vec_id"]) for g in nearest(table, slack=slack, shard_rows=1500, leaf_rows=32).collect()}
        assert len(got) == 3000 and len(got & want) >= least * len(want)
    p, tree = np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))], None
    tree = VantageTree(p, 32)
    q = np.c_[x[::20], np.zeros(150)]
    bound = tree.least_distances(np.linalg.norm(q[:, None] - p[tree.points][None], axis=2))
    kth = np.sqrt(np.maximum(2 - 2 * np.sort(score, axis=1)[:, -20], 0))
    seen = [(bound * slack <= kth[:, None]).mean() for slack in (1, 2)]
    assert seen[1] < seen[0] < 0.5


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in edited_likeness(docs, low=0.02, high=0.9).collect()}
    rows = list(enumerate(texts()))
    for i, t in rows:
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    by = defaultdict(set)
    for i, t in rows:
        by[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert np.mean([g["near_edited"] for g in got.values()]) > np.mean([g["near_next"] for g in got.values()])
    assert edited_likeness(none).count() == 0


def test_fingerprints_of_large_groups(spark):
    """With the band of production: near copies on a third of the rows keep their links, and exact copies move no term."""
    from stratalog.llm.imatch import distinct_texts, lexicon

    r = random.Random(9)
    text = lambda: [f"w{r.randrange(2000)}" for _ in range(60)]
    base = [f"g{i}" for i in range(80)]
    near = lambda i: [*base[:20], f"rare{i}", *base[20:]]
    rows = [(i, " ".join(near(i) if i < 60 or i < 180 and i % 4 == 0 else text())) for i in range(270)]
    got = {x["doc_id"]: x for x in edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i]["near_next"] for i in range(59)]) > 0.5
    assert min(got[i]["near_next"] for i in range(59)) > 0
    assert np.mean([got[i]["near_edited"] for i in [*range(59), *range(60, 180, 4)]]) > 0.2
    assert np.mean([got[i]["near_edited"] for i in range(60, 180, 4)]) > 0.1
    assert np.mean([got[i]["near_next"] for i in range(180, 269)]) < 0.05
    alone = [(i, " ".join(text())) for i in range(200)]
    copies = alone + [(1000 + i, alone[0][1].upper() + ".") for i in range(100)]
    bands = [{x["t"] for x in lexicon(spark.createDataFrame(t, "id long, text string"))[0].collect()} for t in (alone, copies)]
    assert bands[0] == bands[1] and bands[0]
    for most in (0, 10):
        once, n = distinct_texts(spark.createDataFrame(copies, "id long, text string"), "id", "text", most)
        assert n == 200 and sorted(x["id"] for x in once.collect()) == list(range(200))


def lag(order, weights, slots):
    """The largest distance of a source from its weight's share of the slots run, over so many slots of repeated periods."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    part = {s: int(w * scale) for s, w in exact.items()}
    total, far, ran = sum(part.values()), 0, dict.fromkeys(part, 0)
    for t in range(slots):
        ran[order[t % len(order)]] += 1
        far = max(far, max(abs(ran[s] * total - w * (t + 1)) for s, w in part.items()))
    return far / total


@pytest.mark.parametrize("weights, slots", [
    ({"a": 3.0, "b": 2.0, "": 1.0}, 100_000), ({f"s{i}": 1 for i in range(20)}, 20_000), ({"hot": 10_000, "rare": 1}, 100_000), ({"x": 0.7, "y": 0.123, "z": 0.177}, 20_000),
    ({f"s{i}": 1 + i % 7 for i in range(60)} | {"half": 230}, 5_000), ({"a": 2 / 3, "b": 1 / 3}, 100_000),
])
def test_pfair_deviation(spark, weights, slots):
    """Less than one block from the given weights, at every slot."""
    parts = whole_parts(weights)
    got = sorted((r["slot"], r["source"], r["nth"]) for r in pfair_period(spark, parts).collect())
    assert [s for s, _, _ in got] == list(range(sum(parts.values())))
    far = lag([s for _, s, _ in got], weights, slots)
    assert far < 1
    nth = Counter()
    for _, s, n in got:
        assert nth[s] == n
        nth[s] += 1


def test_whole_parts():
    assert whole_parts({"a": 3.0, "b": 2.0, "c": 1.0}) == {"a": 3, "b": 2, "c": 1} == whole_parts({"a": 0.75, "b": 0.5, "c": 0.25})
    long = whole_parts({"a": math.pi, "b": math.e, "c": 1e-9}, most=1000)
    assert long == {"a": 536, "b": 464, "c": 1} and whole_parts({}) == {}
    for w in (0, -1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            whole_parts({"a": 1.0, "b": w})


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, "x") for i in range(3000)] + [(5, "a", "x"), (None, "b", "x")]
    table = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"a": 3.0, "b": 2.0, "": 1.0, "not there": 9.0}
    got = mix_sources(table, weights, block_rows=4, bucket_rows=100).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r["mix_slot"], (r["source"], r["mix_block"])) == (r["source"], r["mix_block"])
    # all sources last so long: 501 rows of b are 126 blocks of 2 in 6 slots
    assert lag([slots[s][0] or "" for s in range(375)], {"a": 3, "b": 2, "": 1}, 375) < 1
    again = mix_sources(table.repartition(5), weights, block_rows=4, bucket_rows=100, most_broadcast=0).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(table.limit(0)).count() == 0


def test_mixing_many_sources_and_null_ids(spark):
    """300 sources keep their weights; a third of the rows without an id is spread over buckets; rows without an id have definite places."""
    rows = [(None if i % 3 == 0 else i, f"s{i % 300}", f"text {i}") for i in range(9000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_sources(table, {f"s{i}": 1 for i in range(300)}, block_rows=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, c) for a, _, c in rows)
    at = {r["mix_slot"]: r["source"] for r in got}
    assert lag([at[s] for s in range(3000)], {f"s{i}": 1 for i in range(300)}, 3000) < 1
    again = mix_sources(table.repartition(7), {f"s{i}": 1 for i in range(300)}, block_rows=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_warc_bad_records(spark, tmp_path):
    """A malformed record, a damaged or cut member, rubbish and an odd charset cost themselves only."""
    import gzip

    from stratalog.llm.warc import read_errors, read_responses, record

    def response(n, kind="text/html"):
        return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>"), ("WARC-Target-URI", f"http://{n}/")], f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n<p>page {n}".encode())

    bad = [response(2).replace(b"Content-Length: ", b"Content-Length: x"), response(3).replace(b"Content-Length: ", b"Content-Length: -"), response(4).replace(b"Content-Length", b"Length")]
    (tmp_path / "a.warc").write_bytes(response(1) + b"".join(bad) + response(5) + b"rubbish\r\n" + response(6, "text/html; charset=a\0b") + response(7, "text/html; charset=idna") + response(8)[:-20])
    parts = [gzip.compress(response(n)) for n in range(10, 16)]
    parts[1] = parts[1][:30] + b"\xff\xff\xff" + parts[1][33:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[:5]) + parts[5][:40])
    whole = gzip.compress(b"".join(response(n) for n in range(20, 40)))
    (tmp_path / "c.warc.gz").write_bytes(whole[: len(whole) * 2 // 3])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(b"\x1f\x8b")
    ids = sorted(int(r["record_id"][1:-1]) for r in read_responses(spark, str(tmp_path)).collect())
    assert ids[:8] == [1, 5, 6, 7, 10, 12, 13, 14] and ids[8:] == list(range(20, 20 + len(ids) - 8)) and 0 < len(ids) - 8 < 20
    errors = Counter((r["path"].rpartition("/")[2], r["record_id"]) for r in read_errors(spark, str(tmp_path)).collect())
    assert all(errors["a.warc", f"<{n}>"] == 1 for n in (2, 3, 4)) and errors["a.warc", None] >= 2 and errors["b.warc.gz", None] >= 2 and errors["c.warc.gz", None] == 2 and errors["e.warc.gz", None] == 1
    made = {(r["refers_to"], r["type"]): bytes(r["record"]) for r in derivatives(read_responses(spark, str(tmp_path))).collect()}
    assert len(made) == 2 * len(ids) and all(f"page {n}\n".encode() in made[f"<{n}>", "conversion"] for n in ids)


def test_lm_scoring(docs, spark, none):
    good = spark.createDataFrame([(i,) for i in range(0, 30)] + [(None,), (999,)], "doc_id long")
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs, good, block=2000).collect()}
    rows = {i: SPACE.findall(lower(t or "")) for i, t in enumerate(texts())}
    uni, bi, heads = ({True: Counter(), False: Counter()} for _ in range(3))
    for i, w in rows.items():
        uni[i < 30].update(w)
        bi[i < 30].update(zip(w, w[1:], strict=False))
        heads[i < 30].update(w[:1])
    v = len(uni[True] | uni[False])
    for i, w in rows.items():
        if not w:
            assert got[i]["n_tokens"] == 0 and got[i]["score"] is None
            continue
        loss = {}
        for side in (True, False):
            mine = side == (i < 30)
            u, b = (uni[side] - Counter(w), bi[side] - Counter(zip(w, w[1:], strict=False))) if mine else (uni[side], bi[side])
            n = sum(uni[side].values()) - (len(w) if mine else 0)
            p = [(u[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
            loss[side] = (-math.log(p[0]) - sum(math.log((b[a, c] + 5 * q) / (u[a] + 5)) for (a, c), q in zip(zip(w, w[1:], strict=False), p[1:], strict=True))) / len(w)
        assert got[i]["target_loss"] == pytest.approx(loss[True]) and got[i]["background_loss"] == pytest.approx(loss[False]), i
    assert cross_entropy_difference(none, good).count() == 0


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learnt, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    scores = quality_scores(table, learnt)
    right = scores.join(held, "doc_id").selectExpr("avg(cast(keep = (quality = 1) as int)) as a").first()["a"]
    most = held.selectExpr("avg(quality) as a").first()["a"]
    assert right >= 0.97 > max(most, 1 - most) + 0.05 and scores.count() == table.count()
    kept = keep_quality(table, labels)
    assert kept.columns == table.columns and 0 < kept.count() < table.count()
    assert keep_quality(docs, labels.limit(0)).count() == docs.count() and quality_scores(none, labels).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<html><head><title>T</title></head><body><p>é &amp; x</p><a href='/y'>l</a></body></html>", "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, record string")
    got = derivatives(page_responses(pages), keep=("page_id",)).collect()
    assert Counter((r["page_id"], r["type"]) for r in got) == {(1, "metadata"): 1, (1, "conversion"): 1, (2, "metadata"): 2, (2, "conversion"): 2}
    for r in got:
        (headers, block), = parse_records(bytes(r["record"]))
        assert headers["warc-refers-to"] == r["refers_to"] and headers["warc-block-digest"] == r["block_digest"] and int(headers["content-length"]) == len(block)
        if r["page_id"] == 1 and r["type"] == "conversion":
            assert block.decode() == "é & x\nl\n"
        if r["page_id"] == 1 and r["type"] == "metadata":
            assert b'"title": "T"' in block and b'"/y"' in block
    assert derivatives(page_responses(pages.limit(0))).count() == 0


def test_warc_source_headers_and_codings(spark, tmp_path):
    """All source headers come through, repeated ones too; chunked, gzip and deflate bodies are read."""
    import gzip
    import json
    import zlib

    from stratalog.llm.warc import digest, read_responses, record

    page = "<html><head><title>Tü</title></head><body><p>Text é</p><a href='/y'>l</a></body></html>".encode()
    raw = zlib.compressobj(wbits=-15)
    chunk = lambda b: b"".join(b"%x;a=b\r\n%s\r\n" % (len(x), x) for x in (b[:7], b[7:])) + b"0\r\n\r\n"
    packed = gzip.compress(page[:20]) + gzip.compress(page[20:])
    bodies = {
        "plain": (b"", page), "gzip": (b"Content-Encoding: gzip\r\n", packed), "deflate": (b"content-encoding: deflate\r\n", zlib.compress(page)),
        "raw": (b"Content-Encoding: deflate\r\n", raw.compress(page) + raw.flush()), "chunked": (b"Transfer-Encoding: chunked\r\n", chunk(page)),
        "both": (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunk(packed)), "stored": (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", page),
        "br": (b"Content-Encoding: br\r\n", b"\x0b\x02\x80page\x03"),
    }
    heads = [("WARC-Type", "response"), ("WARC-Date", "2024-05-06T07:08:09Z"), ("WARC-IP-Address", "192.0.2.7"), ("WARC-Block-Digest", "sha1:AAAA"), ("WARC-Concurrent-To", "<urn:uuid:1>"),
             ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Warcinfo-ID", "<urn:uuid:3>"), ("WARC-Truncated", "length"), ("WARC-Identified-Payload-Type", "text/html"), ("X-Own", "é")]
    data = b"".join(record([*heads, ("WARC-Record-ID", n)], b"HTTP/1.1 200 OK\r\n" + h + b"\r\n" + b) for n, (h, b) in bodies.items())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    made = {(r["refers_to"], r["type"]): r for r in derivatives(read_responses(spark, str(tmp_path))).collect()}
    assert len(made) == 2 * len(bodies)
    for n, (_, body) in bodies.items():
        meta, text = (next(parse_records(bytes(made[n, t]["record"])))[1] for t in ("metadata", "conversion"))
        meta = json.loads(meta)
        assert meta["source_headers"][: len(heads) + 1] == [list(x) for x in [*heads, ("WARC-Record-ID", n)]]
        assert (meta["html"], text.decode()) == (({"title": "", "links": []}, "") if n == "br" else ({"title": "Tü", "links": ["/y"]}, "Text é\nl\n")), n
        assert meta["http"].get("undecoded") == (["br"] if n == "br" else None)
        assert made[n, "metadata"]["source_digest"] == digest({"chunked": page, "both": packed}.get(n, body))
    pages = page_responses(spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string"))
    for given, some in ((pages, True), (pages.drop("headers"), False)):
        record_, = (r["record"] for r in derivatives(given).collect() if r["type"] == "metadata")
        assert (b'["WARC-Identified-Payload-Type", "text/html"]' in bytes(record_)) == some


def test_html(spark):
    def page(n):
        return f"<html><body><nav><a>menu</a></nav><div class='wrap'><div class='story'><h1>Title {n}</h1><p>Body <b>{n}</b>\n of\ttext &lt;{n}&gt;</p><p>More {n}</p></div><div class='sidebar'><p>side {n}</p></div><div id='comments'><p>reader {n}</p></div></div><footer>foot</footer><script>x</script></body></html>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(6)] + [(7, "http://z/1", "<article>only <br>this</article> <aside>no</aside>"), (8, None, None), (9, "http://z/2", "plain &amp; text")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract_articles(table).collect()}
    assert got[3][1] == "Title 3\nBody 3 of text <3>\nMore 3" and got[3][2] == len(got[3][1])
    assert got[7][1] == "only this" and got[8] == (None, "", 0) and got[9][1] == "plain & text"
    assert {k: v for k, v in got.items()} == {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract_articles(table, most_broadcast=0).collect()}
    assert extract_articles(table.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", [
    "<body class='single has-sidebar'>{}</body>", "<body class='sidebar'>{}</body>", "<body><div class='no-sidebar content'>{}</div></body>",
    "<body><article class='comments-open'>{}</article></body>", "<body><div id='page-with-nav'>{}</div></body>", "<body><form action='/'>{}</form></body>",
    "<body><div class='widget'>{}</div><p class='ad'>buy</p></body>", "<body><nav>{}</body>",
])
def test_html_marked_wrappers(spark, wrap):
    """Names on wrappers do not empty pages; real boilerplate still goes."""
    inner = "<div class='article-header'><h1>Head {0}</h1></div><p>Body text of page {0}, long enough.</p><section id='related-work'><p>Work {0}</p></section><div class='comments'><p>reader</p></div><div class='cookie-banner'>eat</div>"
    rows = [(i, f"http://h/{i}", f"<html>{wrap.format(inner.format(i))}</html>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Head {0}\nBody text of page {0}, long enough.\nWork {0}" + ("\nreader\neat" if "<nav>" in wrap else "")
    assert got == {i: want.format(i) for i in range(4)}


def test_html_marked_parts(spark):
    """A paragraph of an article may be called a notice; comments longer than the article are still left out."""
    rows = [(1, "http://a/1", "<article><h1>T</h1><p class='notice'>Corrected.</p><p>Text</p></article>"), (2, "http://b/1", f"<div class='post'><h1>T</h1><p>Short</p></div><div id='comments'><p>{'long ' * 50}</p></div>")]
    got = {r["page_id"]: r["text"] for r in extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T\nCorrected.\nText", 2: "T\nShort"}


def test_quality_of_odd_rows(spark):
    """Nulls in any column, repeated ids, contradictory labels and clashing columns; equal rows have equal scores."""
    r = random.Random(2)
    good, bad = (lambda i: " ".join(f"word{r.randrange(90)}" for _ in range(40)) + "."), (lambda i: "$$$ " + "BUY NOW!!! " * 20 + str(i))
    rows = [(i, bad(i) if i % 2 else good(i), "en", "web" if i % 2 else "book", 100 + i) for i in range(200)] + [(1000, None, None, None, None), (1000, None, None, None, None), (None, good(0), "en", None, -5), (1001, "", "", "", 0)]
    table = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, p_text double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 200, 1)] + [(4, 0), (None, 1), (9999, 0), (6, None), (8, 7)], "doc_id long, quality int")
    got = quality_scores(table, labels).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    assert all(x["keep"] == (x["doc_id"] % 2 == 0) for x in got if x["doc_id"] is not None and x["doc_id"] < 200)
    assert len({tuple(round(v, 9) for v in x) for x in got if x["doc_id"] == 1000}) == 1


def test_quality_by_words_alone(spark):
    """Texts that differ in their words only, not in any count of characters, are told apart by the text view."""
    r = random.Random(4)
    kinds = (["abide", "bacon", "cedar", "delve", "eagle"], ["fable", "gavel", "haste", "ideal", "jelly"])
    rows = [(i, " ".join(r.choice(kinds[i % 2]) for _ in range(30)), "en", "web", 179) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)], "doc_id long, quality int")
    got = quality_scores(table, labels).where("doc_id >= 300").collect()
    assert len(got) == 300 and all((g["p_text"] > 0.8) == (g["doc_id"] % 2 == 1) and (g["p_text"] < 0.2) == (g["doc_id"] % 2 == 0) for g in got)


def test_next_ids_over_many_ranges(spark):
    """Each id's neighbours come right across the ends of ranges, for few and many rows in one."""
    from stratalog.llm.imatch import next_ids

    r = random.Random(8)
    ids = sorted(r.sample(range(-(10**6), 10**6), 700))
    table = spark.createDataFrame([(i, i % 97) for i in r.sample(ids, len(ids))], "id long, n long")
    for bucket_rows in (7, 350, 10_000):
        got = {x["id"]: (x["n"], x["next"], x["prev"], x["prev_n"]) for x in next_ids(table, bucket_rows).collect()}
        assert got == {i: (i % 97, ids[(k + 1) % len(ids)], ids[k - 1], ids[k - 1] % 97) for k, i in enumerate(ids)}, bucket_rows
    assert next_ids(table.limit(0)).count() == 0


def test_long_texts_are_cut_between_words():
    """Pieces of any size give the same words."""
    r = random.Random(6)
    data = np.frombuffer("".join(r.choice("abc DE\té\n") for _ in range(3000)).encode() + b"x" * 500, np.uint8)
    offsets = np.array([0, 0, 700, 1500, 1500, len(data)])
    want = word_hashes(data, offsets)
    for most in (1, 7, 64, 1000):
        got = word_hashes(data, offsets, most=most)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all(), most


def test_packed_numbers():
    """Numbers at the edges of every class come back."""
    from stratalog.llm.bpe import HIGH, LOW, MIDDLE, _numbers, _unnumbers

    edges = np.array([0, LOW - 1, LOW, LOW + 255, LOW + 256, MIDDLE - 1, MIDDLE, MIDDLE + 65535, MIDDLE + 65536, HIGH - 1, HIGH, HIGH + 1, 1 << 40])
    for values in (edges, edges[:0], edges[:1]):
        assert _unnumbers(_numbers(values)).tolist() == values.tolist()


def test_block_of_words_is_lean():
    """Cutting and packing a block takes few bytes per pre-token beside its texts, and a long block comes back as its pieces do."""
    import tracemalloc

    from stratalog.llm.bpe import SLICE, PreTokens, _numbers

    cut, text = PreTokens(tokenizers.PATTERN), "a word or two, and " * 20_000
    for _ in range(8):
        cut.add(text)
    tracemalloc.start()
    words, _, per_text, flat = cut.block(4)
    _numbers(flat)
    assert tracemalloc.get_traced_memory()[1] < 24 * len(flat)
    tracemalloc.stop()
    assert len(flat) > 3 * SLICE and per_text.sum() == len(flat)
    assert "".join(words[i] for i in flat.tolist()) == text * 8


@pytest.mark.parametrize("weights", [{"a": 0.61803, "b": 0.38197}, {"a": 500000, "b": 300001, "c": 199999}, {"a": np.float32(0.5), "b": np.int64(1), "c": Fraction(1, 3)}])
def test_pfair_long_periods(spark, weights):
    """Periods of up to a million slots, numbers of any kind: at every slot each source is less than one block off its exact share."""
    parts = whole_parts(weights)
    period = sum(parts.values())
    rows = pfair_period(spark, parts).toPandas().sort_values("slot")
    assert rows["slot"].tolist() == list(range(period))
    for s, n in parts.items():
        ran = np.cumsum((rows["source"] == s).to_numpy(np.int64))
        off = np.abs(ran * period - n * (np.arange(period, dtype=np.int64) + 1))
        assert off.max() < period and ran[-1] == n


def test_pfair_of_very_many_sources(spark):
    """Fifty thousand sources, one of half the weight: no source is ever a block off."""
    weights = {f"s{i:05d}": 1 for i in range(50_000)} | {"hot": 50_000}
    rows = pfair_period(spark, whole_parts(weights)).toPandas().sort_values("slot")
    hot = np.cumsum((rows["source"] == "hot").to_numpy(np.int64))
    slot = np.arange(100_000) + 1
    assert len(rows) == 100_000 and (np.abs(2 * hot - slot) < 2).all()
    others = rows[rows["source"] != "hot"]
    assert others["source"].is_unique and others["nth"].eq(0).all()
