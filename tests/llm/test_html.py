"""HTML extraction: broken markup, noise, wrappers, and whole pages against a plain reading."""

import html as entities
import json
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.llm import html_extract as X
from weir.llm import queries

NOISE = """<header class="site-header"><a href="/">Site</a><h1>Site name</h1></header><nav><ul><li><a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Popular</div><div class="ad">Buy now</div><aside>Related</aside>
<form><label>Mail</label><input><button>Go</button></form><script>var x = "<p>no</p>";</script><style>p{}</style><noscript>Off</noscript>"""
AFTER = """<section class="comments"><h2>Comments</h2><article class="comment"><p>First! A very long comment that goes on and on and on, longer than the text.</p></article></section>
<div class="share">Share</div><footer><p>&copy; Site</p></footer>"""


def wrap(html):
    return X.wrapper_of(X.blocks_of(X.parse(html)))


def page(body, before=NOISE, after=AFTER):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{body}{after}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head</h1><p>One\n two</p><p>Three</article>", "Head\n\nOne two\n\nThree"),
        ("<article><header><h1>Head</h1></header><p>A &amp; B &#233; &lt;b&gt; &nbsp;c</p></article>", "Head\n\nA & B é <b> c"),
        ("<article><p>a<br>b<b>c</b>d<br><p>e</article>", "a bcd\n\ne"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "x\n\ny\n\n1\n\n2\n\n3"),
        ("<article><p>text</p><div class='ad'>advert</div><aside>side</aside><form>f</form><nav>n</nav><p>more</p><script>s</script></article>", "text\n\nmore"),
        ("<main><h1>Head</h1><p>Words of the text that is long enough to be it.</p><div class='newsletter'>Subscribe</div></main>", "Head\n\nWords of the text that is long enough to be it."),
        ("<div class='post-content'><p>Words of the text.</p><p>More</p></div>", "Words of the text.\n\nMore"),
        ("<div><p>Words of the text that is long enough to be it.</p><p>More words of it, and more.</p></div>", "Words of the text that is long enough to be it.\n\nMore words of it, and more."),
        ("<article><p>a <!-- no --> b<![CDATA[ c]]></p><p title='x>y'>d</p></article>", "a b c\n\nd"),
        ("<article><div role='navigation'>n</div><p hidden>h</p><p style='display: none'>h</p><p>t</p></article>", "t"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>first</p></article><article><p>second</p></article>", "first\n\nsecond"),
        ("<article></p>stray</div></article>", "stray"),
        ("", ""),
    ],
)
def test_extract(body, want):
    assert X.extract(page(body)) == want


def test_cut_and_empty_pages():
    assert [X.extract(h) for h in (None, "", "   ", "<", "<article", "<!--", "<p", "</p>", "<script>x")] == ["", "", "", "<", "", "", "", "", ""]
    assert X.extract("<body><article><p>cut off here") == "cut off here"
    assert X.extract("<article><p>" + "long " * 100_000 + "</p></article>") == ("long " * 100_000).strip()


def test_fixed_texts_of_a_host_are_the_templates():
    make = lambda i: page(f"<article><h1>Title {i}</h1><div>Reading time matters</div><p>Text {i} of its own.</p><p>Always the same ending.</p></article>")
    pages = [make(i) for i in range(4)]
    w = X.align([wrap(h) for h in pages])
    assert X.extract(pages[1], w) == "Title 1\n\nText 1 of its own.\n\nAlways the same ending."
    same = X.align([wrap(pages[0]) for _ in range(4)])  # copies say nothing about a template
    assert "Reading time matters" in X.extract(pages[0], same)


def test_wrappers_are_union_free_expressions():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><p>x</p><b>new</b>", "<ul><li>c</ul><p>x</p>"]
    w = X.align([wrap(p) for p in pages])
    assert X.expression(w) == "<#page><ul>(<li>SLOT</>)+</><p>TEXT</>(TEXT)?</>"
    groups = ["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>a</h2><p>b</p>", "<div>x</div><h2>a</h2><p>b</p><h2>a</h2><p>b</p><h2>a</h2><p>e</p><pre>z</pre>"]
    w = X.align([wrap(p) for p in groups])
    assert X.expression(w) == "<#page>(<div:text>TEXT</>)?(<h2>SLOT</><p>SLOT</>)+(<pre>TEXT</>)?</>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>a</p>", "<p>b</p>", "<h2>c</h2>", "<div><p>a</p><ul><li>q<li>r</ul></div>", "<div class=x>z</div>", "run <b>z</b>", "<table><tr><td>1</table>"]), max_size=9), min_size=1, max_size=5))
def test_a_wrapper_covers_every_page_it_is_made_of(pages):
    pages = ["".join(p) for p in pages]
    w = X.align([wrap(p) for p in pages])

    def covered(block, own):
        assert own is not None
        for part, i in zip(block.items, X.laid(block, own), strict=True):
            if isinstance(part, X.Block):
                covered(part, i)
            else:
                assert i is not None and i[X.TEXT] in (0, i[X.TEXT])

    for p in pages:
        covered(X.blocks_of(X.parse(p)), w)
        assert "".join(re.sub("<[^>]*>", "", p).split()) == "".join("".join(t for t in _runs(X.blocks_of(X.parse(p)))).split())
    assert json.loads(X._dump(w)) == w


def _runs(block):
    for part in block.items:
        if isinstance(part, X.Block):
            yield from _runs(part)
        else:
            yield part[0]


def test_wrappers_stay_small():
    """Names that differ on every page, irregular sequences and deep nesting make no wrapper that grows with the pages."""
    rng = random.Random(1)
    make = lambda: "".join(f"<{t} class='c{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}z'>{rng.random()}</{t}>" for t in (rng.choice(["p", "h2", "div", "ul", "pre", "table", "section"]) for _ in range(60)))
    w = X.align([wrap(make()) for _ in range(60)])
    few = len(X._dump(w))
    for _ in range(60):
        X._merge(w, wrap(make()))
    assert len(X._dump(w)) < 1.5 * few + 2000 and few < 30_000


@pytest.mark.parametrize(("many", "tag"), [(100_000, "div"), (100_000, "b"), (5_000, "ul><li"), (3_000, "article")])
def test_deep_nesting(many, tag):
    page = f"<article><p>{f'<{tag}>' * many}deep text" + f"</{tag.split('>')[0]}>" * many + "<p>after</p>"
    w = X.align([wrap(page) for _ in range(3)])
    assert isinstance(X._dump(w), str) and X.extract(page) == X.extract(page, w) == "deep text\n\nafter"


def test_quotes_in_attributes():
    assert X.extract("<article><p title=it's>a</p><p title=\"x > y\" data-q='>'>b</p><p title=\"never closed>c</p></article>") == "a\n\nb\n\nc"


@pytest.mark.parametrize("name", ["related-work", "legal", "discussion", "social-science", "search-results-of-the-study"])
def test_sections_of_an_article_whose_names_sound_like_noise(name):
    assert X.extract(page(f"<article><p>a</p><section class='{name}'><h2>h</h2><p>prose</p></section><div class='share-buttons'>x</div></article>")) == "a\n\nh\n\nprose"


def test_nothing_is_left_out_for_being_small():
    assert X.extract(page("<div class='post-body'><p>" + "long " * 300 + "</p></div><div class='post-body'><p>short end</p></div>")).endswith("short end")
    assert X.extract(page("<div><div class=one><p>" + "long " * 85 + "</p></div><div class=two><p>short</p></div></div>")).endswith("short")
    assert X.extract(page("<div><p>text that counts</p><p><a href=x>a source, linked as a whole</a></p></div>")).endswith("a source, linked as a whole")


def renamed(html):
    """A page without any name that says what its parts are."""
    html = re.sub(r"<(/?)(?:nav|footer|aside|article)\b", r"<\1div", html)
    return re.sub(r' class="ad"', ' class="zq"', html)


def test_the_wrapper_finds_the_article_where_nothing_is_named(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = defaultdict(list)
    for r in rows:
        hosts[r.url.split("/")[2].lower()].append(r)
    alone = with_wrapper = total = 0
    for some in hosts.values():
        w = X.align([wrap(renamed(r.html)) for r in some])
        for r in some:
            want = X.extract(r.html)
            total += 1
            alone += X.extract(renamed(r.html)) == want
            with_wrapper += X.extract(renamed(r.html), w) == want
    print(total, alone, with_wrapper, len(hosts))
    assert with_wrapper >= 0.97 * total


def test_a_hosts_template_is_found_by_its_pages():
    """Nothing is named: a bar of links, a notice in paragraphs that all pages repeat, and a footer of bare text."""
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    texts = [[words(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5))] for _ in range(6)]
    make = lambda t: f"<body><div><ul><li><a>Home</a><li><a>{words(1)}</a></ul></div><div><p>This shop closes at six on every day of the week, and so on and on.</p></div><div><h1>{t[0]}</h1>{''.join(f'<p>{x}</p>' for x in t[1:])}</div><div>&copy; Site {words(4)}</div></body>"
    pages = [make(t) for t in texts]
    w = X.align([wrap(p) for p in pages])
    assert [X.extract(p, w) for p in pages] == ["\n\n".join(t) for t in texts]
    assert any("closes at six" in X.extract(p) for p in pages)  # a page alone can't tell


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-pabdivarticle \"'=&;[", max_size=80))
def test_any_text_can_be_read(text):
    assert isinstance(X.extract(text, wrap(text)), str)


def test_whole_pages(spark, sf):
    out = {r.page_id: r for r in queries.op1_html_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(out) == len(rows)
    for r in rows:
        body = re.split("</article>|<footer>", r.html.split("<article>")[1])[0]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:h1|p)>", body)]
        got = out[r.page_id]
        assert got.text == "\n\n".join(b for b in blocks if b) and got.n_chars == len(got.text) and got.url == r.url


@pytest.mark.parametrize("small", [0, 64_000_000])
def test_odd_rows(spark, small):
    rows = [(1, "http://a/x", "<article><p>one</p></article>"), (1, "http://a/x", "<article><p>one</p></article>"), (None, None, None), (2, "no host", "<p>Just some text that stands alone.</p>"), (3, "http://A/y", "")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    out = X.main_text(pages, small)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect()) == [("1", "one", 3), ("1", "one", 3), ("2", "Just some text that stands alone.", 33), ("3", "", 0), ("None", "", 0)]
    assert X.main_text(pages.where("false"), small).count() == 0
