"""Template deduction on generated hosts without article elements: the text that each page was made from is the result."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.llm.html_extract import extract_articles, host_templates, parsed_pages


def host_pages(r, host, n):
    """n pages of a host whose layout is drawn once: constant containers before, within and after the article, an unmarked
    changing container beside it. Gives (url, html, text)."""
    w = lambda k: " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7))) for _ in range(k))
    name, fixed = f"x{r.randint(100, 999)}x", [w(r.randint(2, 12)) for _ in range(4)]
    deep, wrap = r.random() < 0.5, r.random() < 0.5
    for i in range(n):
        title, parts = w(4), [w(r.randint(15, 40)) for _ in range(r.randint(2, 6))]
        head = f"<div class='head'><h1>{title}</h1></div>" if deep else f"<h1>{title}</h1>"
        body = f"<div class='{name}' id='p{i}'>{head}<p>{parts[0]}</p><div class='k1'><p>{fixed[1]}</p></div>" + "".join(f"<p>{p}</p>" for p in parts[1:]) + f"<div class='k2'>{fixed[2]}</div></div>"
        body = f"<div class='k0'><p>{fixed[0]}</p></div>{body}<div class='k4'><p>{w(3)}</p></div><div class='k3'><ul><li>{fixed[3]}</li></ul></div>"
        yield f"http://{host}/{i}", f"<html><body>{f'<div>{body}</div>' if wrap else body}</body></html>", "\n".join([title, *parts])


@pytest.fixture(scope="module")
def hosts(spark):
    r = random.Random(4)
    rows = [(url, html, text) for h in range(6) for url, html, text in host_pages(r, f"h{h}", 20 + 5 * h)]
    rows += [(url, html, text) for url, html, text in rows[:5] for _ in range(30)]  # copies are one page of evidence
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string, want string").repartition(5).cache()
    return table, {i: t for i, (_, _, t) in enumerate(rows)}


def test_generated_hosts(hosts):
    table, want = hosts
    assert {r["page_id"]: r["text"] for r in extract_articles(table).collect()} == want
    assert {r["page_id"]: r["text"] for r in extract_articles(table, most_broadcast=0).collect()} == want


@pytest.mark.parametrize("off", [{"constant": 2.0}, {"support": 2.0}, {"least_pages": 1000}])
def test_the_classes_decide(hosts, off):
    """Without classes, or without constant containers, boilerplate stays."""
    table, want = hosts
    assert {r["page_id"]: r["text"] for r in extract_articles(table, **off).collect()} != want


def test_templates(hosts):
    """A slot per host, with the constant containers within and around it."""
    table, _ = hosts
    rows = table.select(F.col("page_id").alias("key"), "url", F.regexp_extract("url", "//(.*?)/", 1).alias("host"), "html")
    got = {r["host"]: (r["slot"], r["dropped"]) for r in host_templates(parsed_pages(rows).checkpoint())[1].collect()}
    assert set(got) == {f"h{i}" for i in range(6)}
    for slot, dropped in got.values():
        assert slot.split(".")[-1].startswith("x#x") and {p.split("div.")[-1] for p in dropped} == {"k0", "k1", "k2", "k3/ul/li"}


def test_noise_and_few_pages(spark):
    """Single pages of another form change no template; near copies are no template; passages that many articles share stay."""
    r = random.Random(8)
    good = list(host_pages(r, "h", 40))
    odd = [(f"http://h/odd{i}", x, t) for i, (x, t) in enumerate([("", ""), (None, ""), ("<p>other <b>page</b>", "other page"), ("<div class='zz'>" + "word " * 500, "word " * 499 + "word")])]
    passage = "a passage of words that nearly every article of this host has in it, word by word"
    shared = [(f"http://s/{i}", f"<div class='top'>Hello all readers</div><div class='post'><h1>Title {i} {i * i}</h1><p>{' '.join(f'w{i}x{j}' for j in range(40))}</p><p>{passage}</p></div>", None) for i in range(20)]
    copies = [(f"http://c/{i}", f"<div class='post'><h1>One and the same title</h1><p>{' '.join(f'c{j}' for j in range(60))}</p><div class='end'>{' '.join(f'd{j}' for j in range(60))}</div><p>edit {i}</p></div>", None) for i in range(20)]
    rows = good + odd + shared + copies
    table = spark.createDataFrame([(i, u, x) for i, (u, x, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {g["page_id"]: g["text"] for g in extract_articles(table).collect()}
    for i, (url, _, text) in enumerate(rows):
        if text is not None:
            assert got[i] == text, url
        elif "//s/" in url:
            assert got[i].startswith("Title") and got[i].endswith(passage) and "Hello" not in got[i]
        else:
            assert got[i].startswith("One and the same title\nc0 c1") and "d0 d1" in got[i]


def test_runs_within_the_article_and_changing_names(spark):
    """Constant lines beside the paragraphs go, long shared passages stay; a wrapper whose class is another one on each page is no other container."""
    r = random.Random(12)
    w = lambda k: " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7))) for _ in range(k))
    name = lambda: "".join(r.choice("bcdfgh") for _ in range(8))
    rows = []
    for i in range(24):
        title, a, b = w(4), w(30), w(20)
        rows.append((f"http://r/{i}", f"<div class='post'><h1>{title}</h1><p>Share this story now</p><p>{a}</p><p>{b}</p><p>Follow our daily letter</p></div>", f"{title}\n{a}\n{b}"))
        rows.append((f"http://q/{i}", f"<div class='{name()}'><div class='top'>Welcome reader</div><div id='{name()}'><h1>{title}</h1><p>{a}</p></div><div class='end'>Read also our archive</div></div>", f"{title}\n{a}"))
    rows.append(("http://r/short", "<div class='post'><p>Share this story now</p></div>", "Share this story now"))  # nothing else: its text all the same
    rows += [(f"http://few/{i}", f"<div class='post'><p>Share this story now</p><p>text {i}</p></div>", f"Share this story now\ntext {i}") for i in range(7)]
    table = spark.createDataFrame([(i, u, x) for i, (u, x, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    for most in (200_000, 0):
        got = {g["page_id"]: g["text"] for g in extract_articles(table, most_broadcast=most).collect()}
        for i, (url, _, text) in enumerate(rows):
            assert got[i] == text, url


def test_odd_markup_takes_linear_time():
    """Deep nesting, end tags without a start, very long names: a page of some hundred KB is read at once, and nothing is lost."""
    import time

    from stratalog.llm.markup import read_page

    began = time.perf_counter()
    deep = read_page("<div class='wrap'>" * 40_000 + "<p>in the middle</p>" + "</div>" * 40_000 + "<p>after</p>")
    assert [b.text for b in deep.blocks] == ["in the middle", "after"] and sum(len(p) for p, _ in deep.opens) < 200_000 and deep.blocks[1].path == ""
    assert [b.text for b in read_page("<section>" + "</div>" * 50_000 + "x").blocks] == ["x"]
    assert [b.text for b in read_page("<div " + "a" * 100_000 + " b='1'>x</div>").blocks] == ["x"]
    assert [b.text for b in read_page("<div class='ad'>" * 30_000 + "x").blocks] == ["x"]
    assert time.perf_counter() - began < 5
