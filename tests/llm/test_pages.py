"""HTML extraction against pages whose main text is known."""

from __future__ import annotations

import random
from collections import Counter

from tachyline.llm import html_extraction as extraction

PAGES = "page_id long, url string, html string"


def page(body, title="T"):
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{x:">"}}</style>'
        f'<script>var t="</p><article>no";</script></head><body>{body}</body></html>'
    )


def article_pages():
    random.seed(1)
    rows, expected = [], {}
    for i in range(40):
        words = [f"w{random.randrange(400)}" for _ in range(60)]
        paragraphs = [" ".join(words[k : k + 20]) for k in range(0, 60, 20)]
        body = (
            f'<nav><ul><li><a href="/{i}">Menu {i}</a></li></ul></nav><!-- ad <p>hidden</p> --><div class="ad">Buy {i}</div>'
            f"<header>Site</header><article><h1>Head {i} &amp; more</h1><p><b>{paragraphs[0]}<br>next\n  line<p>{paragraphs[1]}</p>"
            f'<aside>Side {i}</aside><form><input value=">"> Sign up</form><div class="comments"><p>Reader says {i}</p></div>'
            f"<ul><li>item &lt;{i}&gt;<li>x</ul><p>{paragraphs[2]}</p></article><footer>&copy; host &middot; foot</footer>"
        )
        rows.append((i, f"https://host{i % 3}.example/{i}", page(body)))
        expected[i] = "\n\n".join(
            [f"Head {i} & more", paragraphs[0] + " next line", paragraphs[1], f"item <{i}>", "x", paragraphs[2]]
        )
    return rows, expected


def test_articles(spark):
    rows, expected = article_pages()
    got = extraction.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id][1] for r in got)


def test_a_template_without_an_article_is_deduced(spark):
    """The container that holds the host's text; its repeated lines belong to the template."""
    random.seed(2)
    rows, expected = [], {}
    for i in range(30):
        paragraphs = [" ".join(f"w{random.randrange(300)}" for _ in range(25)) for _ in range(3)]
        body = (
            f'<div class="top"><a href="/">Home</a> <a href="/{i}">Page {i}</a></div><div id="content"><div>Share this page</div>'
            + "".join(f"<p>{p}</p>" for p in paragraphs)
            + '</div><div class="cookie-notice">We use cookies</div><div class="bottom">All rights reserved</div>'
        )
        rows.append((i, "http://plain.example/x", page(body)))
        expected[i] = "\n\n".join(paragraphs)
    got = extraction.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in got} == expected


def test_odd_pages(spark):
    rows, expected = article_pages()
    odd = [
        (100, None, None), (101, "https://host1.example/", ""), (102, "not a url", "just text &amp; more"), (103, None, "<p>a<p>b"),
        (104, "https://host1.example/a", "<article><p>one<p>two <i>th</i>ree"), (105, "https://host2.example/b", "<script>no end"),
        (106, "https://host2.example/c", "a < b and <p>c"), (None, "https://host0.example/d", page("<article>no id</article>")),
        (104, "https://host1.example/a", "<article>same id</article>"), (107, "https://host0.example/e", "<main>" + "<p>long text " * 20_000),
    ]
    frame = spark.createDataFrame(rows + odd, PAGES)
    for name in ("host", "role", "salt", "main", "text", "own_text", "salts"):
        frame = frame.withColumn(name, frame["url"])
    got = extraction.main_text(frame).collect()
    texts = Counter((r.page_id, r.text) for r in got)
    wanted = Counter(expected.items()) + Counter(
        [(100, ""), (101, ""), (102, "just text & more"), (103, "a\n\nb"), (104, "one\n\ntwo three"), (105, ""), (106, "a < b and\n\nc"),
         (None, "no id"), (104, "same id"), (107, "\n\n".join(["long text"] * 20_000))]
    )
    assert texts == wanted
    assert extraction.main_text(spark.createDataFrame([], PAGES)).isEmpty()


def test_references_are_decoded_run_by_run():
    """As browsers do: a reference doesn't go on behind a tag, and what one stands for isn't decoded again."""
    html = "<article><p>AT&<b>amp;</b>T &amp;lt; R&amp;D&nbsp; &#x41;<!-- -->&#66;</article>"
    assert extraction.extracted(html, None, frozenset()) == "AT&amp;T &lt; R&D AB"


def test_a_large_host_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(extraction, "PAGES_A_SALT", 4)
    rows, expected = article_pages()
    got = extraction.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in got} == expected


def test_equivalence_classes_of_a_host(spark):
    rows, _ = article_pages()
    found = extraction.templates(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.host for r in found) == ["host0.example", "host1.example", "host2.example"]
    assert {r.main for r in found} == {"/html/body/article"}


def test_registered_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extraction.main_text(pages).collect()}
    for row in pages.collect():
        article = row.html.split("<article>")[1].split("</article>")[0]
        for part in article.replace("<b>", "").split("<p>")[1:]:
            block = extraction.clean(part.split("</p>")[0].replace("<br>", " "))
            assert block in got[row.page_id].split("\n\n") or not block
        assert "track(" not in got[row.page_id] and "<" not in got[row.page_id][:1]


def test_a_role_rare_among_one_tasks_pages_is_counted_whole(spark):
    """On all 15 pages of three tasks and on 2 of 5 of another: 17 of 20 make it the template's."""
    random.seed(5)

    def row(i, noted):
        words = " ".join(f"w{random.randrange(300)}" for _ in range(60))
        note = '<div id="extra"><p>Note of the house</p></div>' if noted else ""
        return (i, "http://tasks.example/x", page(f'<div id="content"><p>{words}</p>{note}</div>')), words

    rows = [row(i, i < 17) for i in range(20)]
    pages = spark.createDataFrame(spark.sparkContext.parallelize([r for r, _ in rows], 4), PAGES)
    got = extraction.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: words for r, words in rows}
