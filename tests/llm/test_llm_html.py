from __future__ import annotations

import pytest
from conftest import SMALL, rows
from llm_cases import LONG

from shortfall.llm import html_paths

TEXT = "Some sentences, with commas. They go on for a while, as articles do, and then they end."


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PARAGRAPHS = f"<p>{TEXT}</p><p>Short one.</p><p>{TEXT} More.</p>"
PLAIN = f"{TEXT}\nShort one.\n{TEXT} More."


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (page(f"<nav><a href=x>a</a></nav><article><h1>Head</h1>{PARAGRAPHS}</article><footer>f</footer>"), f"Head\n{PLAIN}"),
        (page(f"<header>Site</header><article><header><h1>Head</h1></header>{PARAGRAPHS}</article>"), f"Head\n{PLAIN}"),
        (page(f"<div id=menu><ul><li><a>x</a></ul></div><div class=content>{PARAGRAPHS}</div><div class='ad-box'>{TEXT}</div>"), PLAIN),
        (page(f"<div class=content><h2>Head</h2>{PARAGRAPHS}</div><div class=comments><p>{TEXT}</p></div>"), f"Head\n{PLAIN}"),
        (page(f"<main><p>{TEXT}</p><aside>{TEXT}</aside><form>{TEXT}<input></form></main>"), TEXT),
        (page(f"<article><p>{TEXT}</p><section id=comments><article><p>{TEXT}</p></article></section></article>"), TEXT),
        (page(f"<div class='cookie-notice'>{TEXT}</div><div><p>{TEXT}</p></div><div class=sidebar>{TEXT}</div>"), TEXT),
        (page(f"<article><p>{TEXT}<p>Unclosed <b>bold<br>line<p>Next</article>"), f"{TEXT}\nUnclosed bold line\nNext"),
        (page(f"<article><ul><li>One<li>Two <a href=x>linked</a> text, still text</ul><p>{TEXT}</p></article>"), f"One\nTwo linked text, still text\n{TEXT}"),
        (page("<article><p>a &amp; b &lt;c&gt; &#233; &eacute; &nbsp; d\n\t e</p></article>"), "a & b <c> é é d e"),
        (f"<body><article><p>{TEXT}</p><p>cut off &am", f"{TEXT}\ncut off &am"),
        (page(f"<article><!-- <p>no</p> --><p>{TEXT}</p><script>if (1 < 2) x()</script></article>"), TEXT),
        (page(f"<div><a href=1>{TEXT}</a></div><div><p>{TEXT}</p></div>"), TEXT),
        ("plain text only", "plain text only"),
        ("", ""),
        (None, ""),
        ("<html><body><script>x</script></body></html>", ""),
        ("<", "<"),
    ],
)
def test_main_text(html, expected):
    assert html_paths.main_text(html) == expected


def test_rows(spark):
    pages = [
        (1, "u", page(f"<article>{PARAGRAPHS}</article>"), "x"),
        (1, "u", page(f"<article>{PARAGRAPHS}</article>"), "x"),
        (None, None, None, None),
        (2, "v", page(f"<article><p>{LONG}</p></article>"), "x"),
        (3, "w", "<div>" * 5000 + "deep" + "</div>" * 5000, "x"),
    ]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")
    found = html_paths.extract(table)
    got = [(r["page_id"], r["url"], r["text"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "u", PLAIN), (1, "u", PLAIN), (None, None, ""), (2, "v", LONG.strip()), (3, "w", "deep")], key=str
    )
    assert found.where("n_chars != length(text)").count() == 0
    assert rows(html_paths.extract(table.limit(0))) == []


def test_given_pages(spark):
    """The article's blocks, found by cutting the page with patterns."""
    import html
    import re

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " " if "<br" in b else "", b)).split()) for b in blocks]
        assert html_paths.main_text(r["html"]) == "\n".join(b for b in plain if b)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (page(f"<div class=content>{PARAGRAPHS}</div><div><article><a href=x>Teaser of another page</a></article></div>"), PLAIN),
        (page(f"<div class=content>{PARAGRAPHS}</div><div class=x><div class=y><article><p>Card</p></article></div></div>"), f"{PLAIN}\nCard"),
        (page(f"<main><div><p>{TEXT * 8}</p><p>{TEXT * 9}</p></div><div class=x>{'<div class=z>Buy</div>' * 12}</div></main>"), f"{TEXT * 8}\n{TEXT * 9}"),
    ],
)
def test_marks_are_only_a_weight(html, expected):
    assert html_paths.main_text(html) == expected


def test_given_pages_without_marks(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert "<article" not in plain and html_paths.main_text(plain) == html_paths.main_text(r["html"])


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (page(f"<div class='content has-sidebar'>{PARAGRAPHS}</div><div class=sidebar>{TEXT}</div>"), PLAIN),
        (page(f"<div class='two-col with-sidebar'>{PARAGRAPHS}</div><div class=comments><p>{TEXT}</p></div>"), PLAIN),
        (page(f"<div class='post share-enabled comments-open'>{PARAGRAPHS}</div>"), PLAIN),
        (page(f"<div class='sidebar-layout'>{PARAGRAPHS}</div><div class='sidebar'><p>{TEXT}</p></div>"), PLAIN),
        (page(f"<article><div class=entry-header><h1>Head</h1></div>{PARAGRAPHS}</article>"), f"Head\n{PLAIN}"),
        (page(f"<article><div class=post-header><h2>Head</h2></div>{PARAGRAPHS}</article>"), f"Head\n{PLAIN}"),
        (page(f"<div class=post><div class=entry-header><h1>Head</h1></div>{PARAGRAPHS}</div>"), f"Head\n{PLAIN}"),
        (page(f"<div class=post>{PARAGRAPHS}</div><div class=comments><p>{TEXT * 20}</p></div>"), PLAIN),
        (page(f"<div class=discussion>{PARAGRAPHS}</div>"), PLAIN),
    ],
)
def test_words_of_compound_names(html, expected):
    assert html_paths.main_text(html) == expected


LONG_TEXT = " ".join([TEXT] * 12)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (page(f"<article><p>{TEXT * 6}</p><table><tr><th>Year</th><td>1907</td></tr><tr><th>Town</th><td>Ulm</td></tr></table></article>"), f"{TEXT * 6}\nYear\n1907\nTown\nUlm"),
        (page(f"<div class=text><p>{LONG_TEXT}</p><dl><dt>Pi</dt><dd>3.14</dd></dl></div>"), f"{LONG_TEXT}\nPi\n3.14"),
        (page(f"<article><p>{LONG_TEXT}</p><figure><img src=x><figcaption>A boat</figcaption></figure><p>{LONG_TEXT}</p></article>"), f"{LONG_TEXT}\nA boat\n{LONG_TEXT}"),
        (page(f"<article>{PARAGRAPHS}<p class=more><a href=x>A whole sentence that is a link.</a></p></article>"), f"{PLAIN}\nA whole sentence that is a link."),
        (page(f"<article><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is right. {TEXT}</p></article>"), f"The value x=2 is right. {TEXT}"),
        (page(f"<article><p>Press <button>Go</button> now. {TEXT}</p><p>A <svg><title>t</title><path d=x /></svg>sign, <script>x('</p>')</script>too. {TEXT}</p></article>"), f"Press now. {TEXT}\nA sign, too. {TEXT}"),
        (page(f"<div class=post>{PARAGRAPHS}</div><div>© 2020 Some Company</div>"), PLAIN),
        (page(f"<div class=post>{PARAGRAPHS}</div><div class=latest><p>{TEXT}</p><p>{TEXT}</p></div>"), PLAIN),
        (page(f"<div class=post>{PARAGRAPHS}</div><section id=reader-talk><p>{TEXT}</p></section>"), PLAIN),
        (page(f"<table><tr><td class=links><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></td><td class=text>{PARAGRAPHS}</td></tr></table>"), PLAIN),
        (page(f"<article><p>Unclosed <button>Go <p>{TEXT}</p></article>"), f"Unclosed\n{TEXT}"),
        (page(f"<div class=post>{PARAGRAPHS}<ul><li><a href=1>One link</a><li><a href=2>Another link</a></ul></div>"), PLAIN),
    ],
)
def test_all_of_the_article_and_nothing_else(html, expected):
    assert html_paths.main_text(html) == expected


@pytest.mark.parametrize("names", ["class=share-of-market", "class=recipe-menu", "id=related-work", "id=notice-period", "id=form-factor", "class='header-image-note'"])
@pytest.mark.parametrize("tag", ["p", "div"])
def test_names_that_only_contain_a_word(names, tag):
    html = page(f"<div class=text>{PARAGRAPHS}<{tag} {names}>{TEXT} And this.</{tag}>{PARAGRAPHS}</div>")
    assert html_paths.main_text(html) == f"{PLAIN}\n{TEXT} And this.\n{PLAIN}"


@pytest.mark.parametrize("name", ["share-buttons", "ad-box", "cookie-notice", "related-posts", "newsletter_signup", "site-footer", "comments-area", "sidebar-2"])
def test_names_that_mean_another_part(name):
    assert html_paths.is_aside(name)
    assert html_paths.main_text(page(f"<div class=text>{PARAGRAPHS}</div><div class={name}><p>{TEXT}</p></div>")) == PLAIN


def plain_scores(found):
    """The ratios path by path, with all sums written out."""
    paths = list(dict.fromkeys(b.path for b in found))

    def ratio(path, number):
        own = [b for b in found if b.path == path]
        return sum(number(b) for b in own) / len(own)

    def text(path):
        own = [b for b in found if b.path == path]
        return max(0, sum(len(b.text) for b in own) - sum(b.linked for b in own)) / len(own)

    def marks(path):
        return ratio(path, lambda b: sum(c in ".,;:!?。，" for c in b.text))

    def common(a, b):
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return (same / max(len(a), len(b)) if a != b else 1.0) ** 2

    scores = {}
    for path in paths:
        near = [(common(path, o.path), o.path) for i, b in enumerate(found) if b.path == path for o in found[max(0, i - 2) : i + 3]]
        whole = sum(w for w, _ in near)
        long = (text(path) + sum(w * text(p) for w, p in near) / whole) / 2
        often = (marks(path) + sum(w * marks(p) for w, p in near) / whole) / 2
        own = [b for b in found if b.path == path]
        scores[path] = 0.0 if sum(b.linked for b in own) > 0.5 * sum(len(b.text) for b in own) else (long * (1 + often)) ** 0.5
    return scores


@pytest.mark.parametrize("shuffled", [False, True])
def test_ratios_of_given_pages(spark, shuffled):
    """Path ratios against plain sums, also on pages without marks and with other class names."""
    import re

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        html = r["html"]
        if shuffled:
            html = re.sub(r"</?article", lambda m: m[0].replace("article", "div"), html)
            html = re.sub(r"class=.(\w+).", lambda m: f"class='c{sum(map(ord, m[1])) % 7}'", html)
        found = html_paths.blocks(html)
        assert html_paths.path_scores(found) == pytest.approx(plain_scores(found))


def test_extra_columns_do_not_matter(spark):
    table = spark.createDataFrame([(1, "u", page(PARAGRAPHS))], "page_id bigint, url string, html string")
    wide = table.selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS body")
    assert rows(html_paths.extract(wide)) == [(1, "u", PLAIN, len(PLAIN))]
