"""Nulls, repeated ids, clashing columns, empty tables and long texts, for operators and stages whose own tests do not have them."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from stratalog.llm.ann import nearest
from stratalog.llm.bpe import bpe_encode
from stratalog.llm.imatch import edited_likeness
from stratalog.llm.lm_score import cross_entropy_difference

tokenizers = pytest.importorskip("public_tokenizers")


def test_lm_scoring_of_odd_rows(spark):
    """Rows without an id are background, repeated ids are rows of their own, own columns of the same names are not read."""
    rows = [(1, "a b c a"), (1, "a b d"), (2, "a b c a"), (None, "x y"), (None, None), (3, ""), (4, "x y " * 3000)]
    docs = spark.createDataFrame([(*r, 5.0, 7) for r in rows], "doc_id long, text string, score double, n_tokens int")
    for ids in ([1], [], [None], [99], [1, 2, 3, 4]):
        targets = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        got = cross_entropy_difference(docs, targets, block=100).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter({(1, 4): 1, (1, 3): 1, (2, 4): 1, (None, 2): 1, (None, 0): 1, (3, 0): 1, (4, 6000): 1})
        assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert cross_entropy_difference(docs.limit(0), docs.select("doc_id").limit(0)).count() == 0


def test_encoding_of_odd_rows(spark):
    import tiktoken

    from stratalog.llm.bpe import ranks

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    code = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    long = " ".join(f"w{i * i % 9973} naïve" for i in range(6000)) + "é" * 7000
    rows = [(1, long), (1, "a"), (None, "b"), (2, None)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe_encode(docs, path, tokenizers.PATTERN).collect())
    assert got == sorted((str(i), code.encode_ordinary(t or "")) for i, t in rows)


def test_neighbours_of_repeated_ids(spark):
    """Queries that share an id share one list, which has no row of that id; candidates that share one are candidates each."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 1.5]), (40, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in nearest(table, k=3).collect() if r["query_id"] == 20)
    assert [g[0] for g in got] == [1, 2, 3] and [g[2] for g in got] == [3.0, 2.0, 1.5] and [g[1] for g in got] == [1, 2, 2]


def test_fingerprints_of_odd_rows(spark):
    """Of rows with one id the smallest text counts, once; rows without an id have no place in the order and are left out."""
    rows = [(1, "other words here"), (1, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, None), (5, ""), (6, "x" * 50_000), (7, "alpha beta gamma delta"), (8, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in edited_likeness(docs).collect()}
    assert {i: r["n_chars"] for i, r in got.items()} == {1: 22, 5: 0, 6: 50_000, 7: 22, 8: 0}
    assert got[1]["fingerprint"] == got[7]["fingerprint"] and got[5]["fingerprint"] == got[8]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))
    one = edited_likeness(docs.where("doc_id = 6")).first()
    assert one["edited_sha256"] == hashlib.sha256(("x" * 50_000).encode()).hexdigest()
    assert edited_likeness(docs.limit(0)).count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Each stage on an empty table, and on one with null and repeated ids, null columns and columns named like its own."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good, bad = "A clear sentence about rivers and hills, number", "zz@@ 00 zz@@ 00 %% zz@@"
    rows = [(i, f"{good} {i} " + " ".join(f"w{i}x{j}" for j in range(30)) if i % 2 else f"{bad} {i} " * 8, "en", "s" if i % 3 else None, 10) for i in range(40)]
    rows += [(None, f"{good} of its own, with no id at all, never seen elsewhere", None, None, None), (3, rows[3][1], "en", "s", 10), (5, rows[7][1], "en", "s", 10), (None, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, mix_slot string, ids string, __gone int, mix_file int"
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], columns).repartition(3)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            out = got.collect()
            if table is not docs:
                assert out == [], name
            elif name == "n-gram Jaccard join":
                texts = Counter(r["text"] for r in out)
                assert set(texts) == {r[1] for r in rows} and all(n == 1 for t, n in texts.items() if t and good in t)
            elif name in ("source mixing", "byte-level BPE"):
                assert len(out) == len(rows), name
            if name not in ("byte-level BPE", "source mixing"):
                assert got.columns == docs.columns
