import html
import random
import re

from promptroute.llm import html_text
from promptroute.llm.queries import op5_html_text
from tests.llm.helpers import by_id, frame

SCHEMA = "page_id long, url string, html string, text string"
MENU = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; Someone, all rights reserved by them</footer>"


def _page(body, menu=MENU, foot=FOOT):
    return f"<!DOCTYPE html><html><head><title>T t</title><style>p{{a:b}}</style></head><body>{menu}{body}{foot}</body></html>"


def _labelled(n=30):
    rng = random.Random(4)
    say = lambda k: " ".join(rng.choice(["one", "two", "three"]) for _ in range(k))
    return [
        _page(f'<div class="ad">{say(12)}</div><article><h1>{say(5)}</h1><p>{say(40)}</p><p>{say(30)}</p></article>')
        for _ in range(n)
    ]


def _weights(spark):
    rows = [(i, "u", h, None) for i, h in enumerate(_labelled())]
    return html_text.fit_weights(frame(spark, rows, SCHEMA))


def test_what_belongs_to_the_text(spark):
    weights = _weights(spark)
    long = "word " * 30
    want = long.strip()
    cases = {
        _page(f"<article><h1>Title</h1><p>{long}</p></article>"): f"Title {want}",
        _page(f"<div><h1>Title</h1><p>{long}</p><p>last</p></div>"): f"Title {want} last",
        _page(f"<article><p>{long}<p>a<b>b</b>c&nbsp;&amp; &lt;d&gt;\n e</article>"): f"{want} abc & <d> e",
        _page(f'<article><p>{long}</p><div class="ad">Buy it now, it is good</div><p>end</p></article>'): f"{want} end",
        _page(f"<article><p>{long}</p><script>var t='</p><p>x';</script><form>Name<input></form><p>end</p></article>"): f"{want} end",
        _page(f'<article><p>{long}</p></article><section id="comments"><p>I like it very much</p></section>'): want,
        _page(f'<aside><p>{long}</p></aside><div class="cookie-notice"><p>{long}</p></div><article><p>{long} x</p></article>'): f"{want} x",
        _page(f"<article><p>{long}<!-- <p>gone</p> --><br>b</p></article>"): f"{want} b",
        f"<article><p>{long}</p><p>cut of": f"{want} cut of",
        f"<article><div class='sidebar'><p>{long}</p></article>": want,
        f"<div class='content has-sidebar'><p>{long}</p></div>": want,
        f"<section id='social-policy'><p>{long}</p></section>": want,
        f"<div class='post no-comments'><p>{long}</p></div>": want,
        f"<div class='postHeader'>Menu of it</div><div class='mainSidebar'>More of it</div><article><p>{long}</p></article>": want,
        f"<article><p>{long}</p><figure><img src='x'><figcaption>What it shows</figcaption></figure></article>": f"{want} What it shows",
        f"<article><p>{long}</p><p><a title=\"x>link text</a> end</p></article>": f"{want} link text end",
        f"<div class='widget'><h1>Title</h1><p>{long}</p></div><p>b</p>": f"Title {want} b",
        "": "",
        "   ": "",
        MENU: "",
        _page(""): "",
    }
    for page, text in cases.items():
        assert html_text.main_text(page, weights) == text, page


def test_a_long_page_is_read_in_time_and_whole():
    parts = [f"<p class='c{i}'>word{i} <b>and</b> more</p><div class='ad'>buy</div><a title=\"open{i}>x</a>" for i in range(12_000)]
    page = f"<body>{MENU}<article>{''.join(parts)}</article>{FOOT}</body>"
    assert len(page) > 1_000_000
    text = html_text.main_text(page, {})
    assert text.startswith("word0 and more") and "buy" not in text and "reserved" not in text


def test_scan_finds_the_best_region():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        every = [(sum(scores[a:b]), a - b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max([x for x in every if x[0] > 0], default=(0, 0, 0))
        start, stop = html_text.best_region(scores)
        assert sum(scores[start:stop]) == best[0]


def test_nulls_repeats_clashes_and_no_pages(spark):
    weights = _weights(spark)
    rows = [(1, None, None, "x"), (2, "u", _labelled(1)[0], "x"), (2, "u", _labelled(1)[0], "x"), (3, "u", "<p>" * 3000 + "a", "x")]
    df = frame(spark, rows, SCHEMA)
    out = html_text.extract(df, weights).orderBy("page_id").collect()
    assert out[0].text == "" and out[1].text == out[2].text and out[1].text.startswith(("one", "two", "three"))
    assert html_text.fit_weights(df.limit(0)) == {}
    assert html_text.extract(df.limit(0), weights).count() == 0


def test_query_returns_the_marked_articles(spark, sf_dir):
    pages = by_id(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    for key, row in by_id(op5_html_text(spark, sf_dir), "page_id").items():
        article = re.search(r"<article>(.*?)</article>", pages[key].html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)[^>]*>", article.replace("<br>", "\n").replace("<b>", ""))
        plain = (" ".join(html.unescape(b).split()) for b in blocks)
        assert row.text == " ".join(b for b in plain if b)
        assert row.n_chars == len(row.text)
