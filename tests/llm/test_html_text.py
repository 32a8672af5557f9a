"""Main text of pages of known articles in many layouts, of broken pages, and of odd rows."""

from __future__ import annotations

import random

import pytest

from curalith.llm import html_text, queries
from curalith.llm.pages import candidates, parse
from tests.llm.fixtures import none  # noqa: F401

R = random.Random(4)
WORDS = ["river", "stone", "quiet", "market", "under", "travels", "evening", "letter", "garden", "often", "bridge", "seldom"]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


NOTICE = "We value your privacy and, like everyone, keep records of what you read, when, and for how long. " * 4
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS) + "</ul>"

#: Layouts as functions of title, paragraphs and a page number; %-places are what no text may come from.
LAYOUTS = {
    "article": lambda t, ps, k: f"<body><nav>{MENU}</nav><article><h1>{t}</h1>" + "".join(f"<p>{p}" for p in ps) + f"</article><footer>&copy; x {NOTICE}</footer></body>",
    "post": lambda t, ps, k: (
        f'<body class="has-sidebar"><div id="page-{k}" class="wrap"><div class="site-header"><a href="/">Home</a></div><div class="post-{k} post"><h1>{t}</h1>'
        + "".join(f"<p>{p}</p>" for p in ps)
        + f'<div class="share-links">Share this</div><form><input><label>Your mail</label></form></div><div id="comments"><div class="comment-{k}"><p>{sentence(60)}</p></div></div>'
        f'<div class="sidebar"><p>{NOTICE}</p></div></div></body>'
    ),
    "plain divs": lambda t, ps, k: f"<body><div>{MENU}</div><div><h1>{t}</h1>" + "".join(f"<div>{p}</div>" for p in ps) + f"</div><div><p>{NOTICE}</p></div></body>",
    "unnamed notice": lambda t, ps, k: f'<body><div class="zq"><p>{NOTICE}</p></div><section class="x{k}"><h2>{t}</h2>' + "".join(f"<p>{p}</p>" for p in ps) + "</section></body>",
    "sections": lambda t, ps, k: f"<body><header><h2>Site</h2></header><main><h1>{t}</h1>" + "".join(f"<section><p>{p}</p></section>" for p in ps) + f"</main><aside>{NOTICE}</aside></body>",
    "comments inside": lambda t, ps, k: (
        f"<body><main><article><header><h1>{t}</h1></header>" + "".join(f"<p>{p}</p>" for p in ps) + f'<section class="comments"><article class="comment"><p>{sentence(80)}</p></article></section></article></main></body>'
    ),
    "table": lambda t, ps, k: f'<body><table><tr><td class="menu">{MENU}<td class="text"><h1>{t}</h1>' + "<br>".join(ps) + f'</table><div role="contentinfo">{NOTICE}</div></body>',
}


def page_of(layout, k):
    title, ps = sentence(4), [sentence(R.choice([3, 8, 30, 60])) for _ in range(R.randint(1, 5))]
    head = '<!DOCTYPE html><html><head><title>No text</title><style>p{}</style><script>var t="</p><p>no";</script></head>'
    return head + LAYOUTS[layout](title, ps, k) + "</html>", " ".join([title, *ps])


@pytest.mark.parametrize("batch", [1, 40])
def test_layouts(spark, batch):
    """Short articles below long notices come out right by their host's other pages; ten hosts to a layout."""
    rows, want = [], {}
    for k in range(560):
        layout = list(LAYOUTS)[k % len(LAYOUTS)]
        html, want[k] = page_of(layout, k)
        rows.append((k, f"https://{layout.replace(' ', '-')}{k % 3}.example.org/{k}", html))
    got = html_text.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(batch)).collect()
    wrong = [(list(LAYOUTS)[r["page_id"] % len(LAYOUTS)], r["main_text"], want[r["page_id"]]) for r in got if r["main_text"] != want[r["page_id"]]]
    assert len(got) == 560 and wrong == []


def text(html):
    return html_text.extracted(html, [])


def test_blocks_references_and_broken_tags():
    assert text("<p>a<b>b</b>c<br>d\n\n e</p><p>&lt;x&gt;&amp;amp; caf&eacute; &#x20AC; &copy 5 &unknown; AT&T</p>") == "abc d e <x>&amp; café € © 5 &unknown; AT&T"
    assert text("<div><p>one<p>two<div>three</div></span></p>four") == "one two three four"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert text("<!-- <p>no</p> --><p title='a > b'>yes</p><script>if (a < b) '</p>'</script><p hidden>no</p><p style='display: none'>no</p>tail <p class=") == "yes tail"
    assert text("a < b and b <3") == "a < b and b <3"
    assert text("<p>open <!-- never closed <p>no") == "open"
    assert text("<nav>only a menu</nav>") == text("") == text("<script>x") == ""
    assert text("<form><div><p>" + "word " * 50 + "</p></div></form>") == ""


def test_paths_are_general():
    page = parse('<body><div class="b-12 a" id="post-77"><p>x</p></div><div>one</div><div>two words here</div></body>')
    assert page.path[2] == "/body/div.a.b-##post-#"
    assert {"/body/div[1]", "/body/div[2]"} <= set(page.path)
    page = parse("<body><div><p>" + "word " * 99 + "</p></div><article><p>Hello there</p></article></body>")
    assert [page.tag[n] for n, _ in candidates(page)] == ["article"]


def test_very_deep_and_very_long_pages():
    assert text("<div>" * 3000 + "<p>deep</p>") == "deep"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert text(f"<body><article><p>{long}</article>") == long
    assert text("<p>" + "<" * 20_000 + "</p>").count("<") == 20_000
    assert text('<a href="' * 2000 + "x") == ""


def test_odd_rows(spark, none):
    rows = [(1, None, None), (2, "no url", ""), (None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (3, "http://h.example/", "plain text"), (3, "HTTP://u@H.example:80/?", "<b>other</b> text")]
    pages = spark.createDataFrame([(*r, "kept", "gone") for r in rows], "page_id long, url string, html string, host string, main_text string")
    got = html_text.with_main_text(pages)
    assert got.columns == ["page_id", "url", "html", "host", "main_text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r, "kept", t) for r, t in zip(rows, ["", "", "x", "x", "plain text", "other text"])), key=repr)
    assert html_text.with_main_text(pages.limit(0)).collect() == []
    assert {r["h"] for r in pages.where("page_id = 3").select(html_text.host_of(pages["url"]).alias("h")).collect()} == {"h.example"}


def test_query_has_every_page(spark):
    out = queries.QUERIES["op12_html_text"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
