import time

from tarn.llm import html_text as H

LONG = "A sentence of the article that is long enough to carry weight. " * 4
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class='ad'>Buy</div>{open}<h1>Title &amp; more</h1><p><b>First{long}<br><p>Short.</p><p>Les <i>deux</i>\n mots&nbsp;x</p><p>{long}</p>{close}"
    "<div id='comments'><p>" + LONG + "</p></div><footer>&copy; us</footer></body>"
)


def page(tag):
    return PAGE.format(open=f"<{tag}>", close=f"</{tag}>", long=LONG)


def test_regions():
    want = ["Title & more", ("First" + LONG).strip(), "Short.", "Les deux mots x", LONG.strip()]
    assert H.blocks(page("article")) == want
    assert H.blocks(page("div")) == want
    assert H.blocks(page("article").replace("</article>", "").replace("</body>", "")) [:5] == want


def test_nothing_to_find():
    assert H.blocks("") == H.blocks("<nav>a</nav>") == H.blocks("<script>x") == []
    assert H.blocks("plain &lt;text&gt;") == ["plain <text>"]
    assert H.blocks("<article><p>One.</p></article>") == ["One."]


def test_one_dominant_block():
    """A region is a container: what stands beside a long paragraph or division is kept."""
    assert H.blocks(f"<body><div><h1>T</h1><p>{LONG * 9}</p><p>{LONG[:60]}</p></div></body>") == ["T", (LONG * 9).strip(), LONG[:60].strip()]
    assert H.blocks(f"<body><ul><li>{LONG * 9}<li>{LONG}</ul></body>") == [(LONG * 9).strip(), LONG.strip()]
    assert H.blocks(f"<body><div><p>{LONG * 3}</p></div><div><p>{LONG}</p></div></body>") == [(LONG * 3).strip(), LONG.strip()]
    assert H.blocks(f"<main><article><p>{LONG * 3}</p></article><p>{LONG}</p></main>") == [(LONG * 3).strip(), LONG.strip()]
    assert H.blocks(f"<div><article><p>{LONG * 3}</p></article><article><p>{LONG * 2}</p></article></div>") == [(LONG * 3).strip(), (LONG * 2).strip()]


def test_marked_wrappers():
    """A class, an id or a form around the article does not drop it; marked boilerplate inside still goes."""
    inner = f"<p>{LONG}</p><p>{LONG}</p><div class='share'>Share this</div>"
    for tag in ("div class='content with-sidebar'", "div id='content-sidebar-wrap'", "div class='page header-fixed'", "section class='legal'", "form", "div class='sidebar'"):
        for text in (inner, f"<article>{inner}</article>"):
            assert H.blocks(f"<body><nav>Home</nav><{tag}>{text}</{tag.split()[0]}><footer>us</footer></body>") == [LONG.strip()] * 2, (tag, text)
    assert H.blocks(f"<article><p>{LONG}</p></article><div id='comments'><article><p>{LONG[:60]}</p></article></div>") == [LONG.strip()]
    assert H.blocks(f"<div class='ad'>{LONG}</div><article><p>Brief.</p></article>") == ["Brief."]
    assert H.blocks(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='cookie-banner'><p>{LONG}</p></div>") == [LONG.strip()] * 2


SHORT = "A short one."


def test_titles_and_short_paragraphs_outside_the_densest_container():
    """Without an article element nothing of the article goes: what is beside the dense container stays."""
    body = f"<p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>"
    want = [LONG.strip(), SHORT, LONG.strip()]
    menu = "<div><ul><li><a href='/'>Home</a><li><a href='/a'>About us all</a></ul></div>"
    assert H.blocks(f"<body>{menu}<div><h1>T</h1><div>{body}</div></div></body>") == ["T", *want]
    assert H.blocks(f"<body>{menu}<h1>T</h1><p>{SHORT}</p><div>{body}</div><p>{SHORT}</p><p>{SHORT}</p>{menu}</body>") == ["T", SHORT, *want, SHORT, SHORT]
    assert H.blocks(f"<body>{menu}<p>{SHORT}</p>{body}<p>{SHORT}</p><p>{SHORT}</p></body>") == [SHORT, *want, SHORT, SHORT]
    assert H.blocks(f"<body>{menu}<div><p>{SHORT}</p><div>{body}</div><ul><li>One</li><li>Two</li></ul></div></body>") == [SHORT, *want, "One", "Two"]
    assert H.blocks(f"<body>{menu}<div>{menu}<div><h2>T</h2>{body}</div>{menu}</div></body>") == ["T", *want]
    assert H.blocks(f"<main><div class='post-header'><h1>T</h1></div><div>{body}</div></main>")[-3:] == want


def test_doubtful_names():
    """Class words that articles bear too do not drop their text."""
    assert H.blocks(f"<main><div class='post-header'><h1>T</h1></div><p>{LONG}</p></main>") == ["T", LONG.strip()]
    assert H.blocks(f"<article><h1>T</h1><section class='legal-analysis'><p>{LONG}</p></section><section class='legal'><p>{LONG}</p></section></article>") == ["T", LONG.strip(), LONG.strip()]
    assert H.blocks(f"<article><p>{LONG}</p><div class='related'><a href='/x'>More</a></div><p>{LONG}</p></article>") == [LONG.strip()] * 2
    assert H.blocks(f"<div class='content with-sidebar'><h1>T</h1><p>{LONG}</p></div>") == ["T", LONG.strip()]


SOUP = "<body><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Shop</a></div><div>Call <b>us</b> <i>now</i> <a href='/t'>x</a></div><div><div>{}</div><div>{}</div></div><div><span>a</span><span>b</span><span>c</span> d</div></body>"


def test_the_clusters_choose(monkeypatch):
    """On pages without telling elements or names the smoothed ratios alone tell the article: without them menus stay."""
    html = SOUP.format(LONG, LONG)
    assert H.blocks(html) == [LONG.strip()] * 2
    with monkeypatch.context() as m:
        m.setattr(H, "smoothed", lambda ratios, sigma=1.0: ratios * 0 + 1)
        assert len(H.blocks(html)) > 2
    with monkeypatch.context() as m:
        m.setattr(H, "threshold", lambda values: 0.0)
        assert len(H.blocks(html)) > 2
    # a short line between dense ones is lifted by its neighbours
    html = f"<div><p>{LONG}</p><div><b>Note</b></div><p>{LONG}</p></div>"
    assert "Note" in H.blocks(html)


AROUND = (
    "<header><h2>The Site</h2><p>News for all</p></header>", '<div class="breadcrumbs"><a href="/">Home</a> / <a href="/x">Section</a></div>',
    '<div class="cookie-notice"><p>We use cookies to improve your visit to this site and show you adverts.</p><button>OK</button></div>',
    '<aside><h3>Popular</h3><ul><li><a href="/a">One story about things</a></li></ul></aside>', '<div class="sidebar"><h3>Popular</h3><p>Read what others read this week.</p></div>',
    '<form action="/s"><p>Subscribe to our newsletter</p><input name="e"><button>Go</button></form>', '<div class="share">Share this</div>',
    f'<div id="comments"><h3>Comments</h3><div class="comment"><p>{LONG * 2}</p></div><div class="comment"><p>Nice.</p></div></div>', '<div class="related-posts"><h3>Related</h3><ul><li><a href="/q">Another</a></li></ul></div>',
)


def test_boilerplate_before_after_and_inside():
    body = f"<h1>Title</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>"
    want = ["Title", LONG.strip(), SHORT, LONG.strip()]
    for open_, close in (("<article>", "</article>"), ("<div class='post'>", "</div>"), ("<main><div>", "</div></main>")):
        for part in AROUND:
            for page in (f"{part}{open_}{body}{close}", f"{open_}{body}{close}{part}", f"{open_}{body}{part}{close}", f"{open_}{part}{body}{close}"):
                if "header" in part and not page.startswith(part) and not page.endswith(part):
                    continue  # a header inside the article is its own
                assert H.blocks(f"<body><nav><a href='/'>Home</a></nav>{page}<footer>us</footer></body>") == want, page


def test_deep_pages_take_time_in_proportion():
    for make in (
        lambda n: "<div>" * n + LONG + "</div>" * n, lambda n: "<i><div>" + "<b>" * n + LONG + "</i>" * n, lambda n: "<div class='ad'>w" * n, lambda n: "<p>" * n + LONG + "</span>" * n,
        lambda n: "".join(f"<div><p>line {i} of text</p>" for i in range(n)),
    ):
        start = time.perf_counter()
        H.blocks(make(100_000))
        assert time.perf_counter() - start < 30
    assert len(H.blocks("".join(f"<div><p>line {i} of text</p>" for i in range(4000)))) == 4000


def test_frame(spark):
    rows = [(1, "u", page("article"), "old"), (1, "u", page("article"), "old"), (2, None, None, None), (3, "v", "", ""), (4, "w", "<p>" + "word " * 50_000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): r.text for r in H.extract(df).collect()}
    assert len(out) == 4 and out[2, None] == out[3, "v"] == "" and len(out[4, "w"]) == 50_000 * 5 - 1
    assert H.extract(df).columns == ["page_id", "url", "text"] and H.extract(df.limit(0)).count() == 0
