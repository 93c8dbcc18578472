from strandex.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">Buy, now, at, once, all, of, it.</div><header class="site-header">Site</header>
<div class="cookie-notice"><p>We use cookies, many of them, everywhere.</p></div>
<{0}><h1>Head &amp; line</h1><p><b>First &lt;one&gt;<br>  more.<p>Second, with <a href="y">a link</a>&nbsp;inside.</p><ul><li>one<li>two</ul>{1}</{2}>
<div id="comments"><p>{3}</p></div><aside>side</aside><form><p>Send us, please, a word.</p></form><footer>&copy; host</footer></body></html>"""
WANT = "Head & line\n\nFirst <one> more.\n\nSecond, with a link inside.\n\none\n\ntwo"


def page(tag='div class="post post-17"', more="", comment="Nice."):
    return PAGE.format(tag, more, tag.split()[0], comment)


def test_article_alone():
    for tag in ("article", "main", 'div class="post post-17"', 'section id="content"'):
        assert H.main_text(page(tag), []) == WANT


def test_odd_markup():
    assert H.main_text("", []) == "" and H.main_text("plain &eacute; text", []) == "plain é text"
    assert H.main_text("<p>a<p>b</div></p><!-- c", []) == "a\n\nb"
    assert H.main_text("<article><p>a < b and \"q\" <i>x</i>y</article>", []) == 'a < b and "q" xy'
    assert H.main_text("<script>unclosed <p>x", []) == ""


def test_consensus_beats_a_page_with_long_comments(spark):
    long_ = "I, too, think so, " * 200
    rows = [(i, f"https://h.example/{i}", page(f'div class="post post-{i}"')) for i in range(20)]
    odd = '<html><body><div class="post post-5"><p>Short.</p></div><div class="box"><p>' + long_ + "</p></div></body></html>"
    rows += [(20, "https://h.example/odd", odd), (None, None, None), (21, None, ""), (20, "https://h.example/odd", odd), (22, "https://other.example", odd)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = H.extracted(pages).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert all(texts[i, f"https://h.example/{i}"] == WANT for i in range(20))
    assert texts[20, "https://h.example/odd"] == "Short."
    assert texts[22, "https://other.example"] == long_.strip()
    assert texts[None, None] == "" and texts[21, None] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extracted(pages.limit(0)).count() == 0


def test_removal_weighs_what_it_takes():
    assert H.main_text('<div class="post social"><p>Body text</p></div>', []) == "Body text"
    assert H.main_text('<div class="content ad"><p>x</p></div><article><p>much longer article text</p></article>', []) == "much longer article text"
    assert H.main_text('<article><p>one</p><div class="legal"><p>two</p></div></article><div class="legal"><p>three</p></div>', []) == "one\n\ntwo"
    assert H.main_text('<article><p>text</p><div class="comments"><p>no</p></div></article>', []) == "text"
    assert H.main_text('<div class="ad"><p>only this</p></div>', []) == ""


def test_malformed_tags_are_never_text():
    for html, want in (("<p title=it's>hello</p>", "hello"), ('<p title="a>b">x</p>', "x"), ("<p>a<a href=\"x", "a"), ("</><p>z</p></ x>", "z"), ("<p a=\"1\"b='2'>k</p>", "k"), ("<p>1 < 2 and <3</p>", "1 < 2 and <3"), ('<div data-x="the hidden gem"><p>t</p></div>', "t"), ("<![CDATA[x", "x")):
        assert H.main_text(html, []) == want, html
    assert H.main_text("<p " + '="x"' * 20_000, []) == ""  # in linear time


def test_paths_with_odd_classes(spark):
    html = '<html><body><div class="a>b"><p>Text, of, it.</p></div><div class="c"><p>other</p></div></body></html>'
    pages = spark.createDataFrame([(i, "https://h.example/", html) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.extracted(pages).collect()} == {"Text, of, it."}


def test_the_given_pages_against_their_articles(spark):
    """In the given tables an article stands in its own element; a plain reading of that is what the query must give."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in H.op6_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h\d|ul|ol|li|table|tr|td|th|blockquote|pre|div|section|article)\b[^>]*>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want, r.page_id
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(want))
