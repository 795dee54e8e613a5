from collections import Counter

import numpy as np

from ticketloom.llm import html_text as h

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">All news</a></li></ul></nav>'
FOOT = "<footer>&copy; site &middot; imprint</footer></body></html>"
TEXT = "One &amp; two  words<br>here.</p><p><b>Bold</b>ly&nbsp;said\n again."


def page(body, head=HEAD, foot=FOOT):
    return head + NAV + body + foot


LABELLED = [page(f"<div class='ad'>Buy {k}</div><article><h1>Title {k}</h1><p>{'word ' * (20 + k)}</p><p>more text</p></article>") for k in range(40)]


def weights():
    counts = Counter()
    for p in LABELLED:
        for kind, text, inside in h.tokens(p):
            if kind != h.TAG:
                counts[kind, inside] += len(text.split()) if kind in (h.WORD, h.LINK) else 1
    return h.Weights(counts)


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 15)).tolist()
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max([0, *sums.values()])
        start, end = h.region(scores)
        assert sum(scores[start:end]) == best
        assert (start, end) == (0, 0) if best == 0 else sums[start, end] == best


def test_article_with_and_without_its_tag():
    w = weights()
    expected = "A title\nOne & two words here.\nBoldly said again."
    assert h.extract(page(f"<article><h1>A title</h1><p>{TEXT}</p></article>"), w) == expected
    long = "<p>" + "many words " * 30 + "</p>"
    assert h.extract(page(f"<div><h1>A title</h1><p>{TEXT}</p>{long}</div>"), w) == expected + "\n" + ("many words " * 30).strip()


def test_boxes_inside_the_article_go():
    w = weights()
    boxes = [
        '<div class="ad-banner"><p>Buy <b>now</b></p></div>', "<aside><p>See also</p></aside>", "<form><label>Mail</label><input name=q></form>", "<script>if (a<b) x='<p>no</p>'</script>",
        '<section id="comments"><article class="comment"><p>First! great read</p></article></section>', '<div role="alert">We use cookies</div>', "<!-- <p>hidden</p> -->",
        '<span class="share">Share this</span>', "<noscript><p>Turn on</p></noscript>", '<div class="cookie-notice"><div>a</div><div>b</div></div>',
    ]
    for box in boxes:
        assert h.extract(page(f"<article><p>First block.</p>{box}<p>Second block.</p></article>"), w) == "First block.\nSecond block.", box


def test_broken_markup():
    w = weights()
    assert h.extract(HEAD + NAV + "<article><p>Open <b>bold<p>Next<ul><li>x<li>y</ul>", w) == "Open bold\nNext\nx\ny"
    assert h.extract("<p>5 < 6 and 7 > 2 <", w) == "5 < 6 and 7 > 2 <"
    assert h.extract('<article><p title="a>b">Quoted</p><p class=\'x>Open quote</p></article>', w).startswith("Quoted")
    assert h.extract("<article><script>never closed <p>text</p>", w) == ""
    for odd in (None, "", "   ", "<!--", "</p></div>", NAV):
        assert h.extract(odd, w) == "", odd
    assert h.extract("plain words only", w) == "plain words only"
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert h.extract(long, w).count("\n") == 49_999
    assert h.extract("<div>" * 5000 + "deep words here " * 60_000 + "</div>" * 5000, w).count("deep") == 60_000


def test_weights_and_query_over_rows(spark):
    rows = [(k, f"u{k}", p, "x") for k, p in enumerate(LABELLED)] + [(None, None, None, "x"), (1, "u1", LABELLED[1], "x"), (99, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    w = h.Weights(h.count(pages))
    assert w(h.WORD) > 0 > w(h.BOX)
    got = h.main_text(pages, w).collect()
    assert len(got) == 43
    for r in got:
        if r.id is not None and r.id < 40:
            assert r.text == f"Title {r.id}\n{('word ' * (20 + r.id)).strip()}\nmore text"
        else:
            assert r.text == ""
    assert h.main_text(pages.limit(0), h.Weights(h.count(pages.limit(0)))).count() == 0


def test_story_in_divs_beside_a_teaser_article():
    story = "".join(f"<p>{'story words ' * 20}part {k}.</p>" for k in range(4))
    got = h.extract(page(f'<div><h1>A title</h1>{story}</div><article class="card"><p>Read this next.</p></article>'), weights())
    assert got.startswith("A title\nstory words") and all(f"part {k}." in got for k in range(4))


def test_wrappers_around_the_page_keep_its_text():
    w = weights()
    body = f"<h1>A title</h1><p>{TEXT}</p><p>{'many words ' * 30}</p>"
    expected = "A title\nOne & two words here.\nBoldly said again.\n" + ("many words " * 30).strip()
    for start, end in (
        ('<div class="page has-sidebar">', "</div>"), ('<div id="no-sidebar">', "</div>"), ('<div class="elementor-widget">', "</div>"), ("<form method=post id=aspnetForm>", "</form>"),
        ('<div class="sidebar-left">', "</div>"), ('<form><div class="widget">', "</div></form>"), ('<div role="form">', "</div>"),
    ):
        assert h.extract(page(start + body + end), w) == expected, start
        assert h.extract(page(f"{start}<article>{body}</article>{end}"), w) == expected, start
        assert h.extract(page(f"{start}{body}<form>Mail <input></form><div class='ads'>Buy now</div>{end}"), w) == expected, start
    parts = "".join(f'<div class="elementor-widget"><p>{"many words " * 10}{k}</p></div>' for k in range(4))
    assert h.extract(page(f"<div>{parts}</div>"), w).count("\n") == 3
    long = '<section id="comments"><article class="comment"><h1>Re</h1><p>' + "great read " * 400 + "</p></article></section>"
    assert h.extract(page(f"<article>{body}{long}</article>"), w) == expected
