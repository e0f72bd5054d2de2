"""Main text of pages written by hand."""

from daygauge.llm.pages import extract, main_text

LONG = "A sentence of the article, with some words in it. Another one follows; it says more."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a><li><a href=b>Menu two</a></ul></nav><div class="ad">Buy this, now. It is cheap.</div><!-- <p>no</p> -->
<article><h1>Head &amp; line</h1><p>{LONG}<p>Second&nbsp;  <b>bold</b> &lt;tag&gt;<br>line &#8364; &eacute<ul><li>item one<li>item two</ul>
<blockquote>Quote.</blockquote><form><p>Your name, please.</p></form><p>Last.</article>
<section id="comments"><p>{LONG}</p></section><aside><p>{LONG}</p></aside><footer>&copy; me</footer></body></html>"""
TEXT = f"Head & line\n{LONG}\nSecond bold <tag> line € é\nitem one\nitem two\nQuote.\nLast."


def test_article():
    assert main_text(PAGE) == TEXT


def test_without_article_element():
    page = f'<body><div class="top-nav"><a>Home</a> <a>More</a></div><div class=story><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>' \
           '<div><a href=x>Link</a></div><div class="siteFooter">Imprint, address. All rights.</div></body>'
    assert main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_paths_above_the_threshold_stay():
    page = f"<body><div class=post><h1>T</h1><p>{LONG}</p><div class=entry>" + f"<p>{LONG} More of it, here.</p>" * 4 + "</div></div></body>"
    assert main_text(page) == "\n".join(["T", LONG] + [LONG + " More of it, here."] * 4)


def test_marked_wrappers_of_the_article_stay():
    rest = f'<div class="comments"><article><p>{LONG}</p></article></div><div class="sidebar"><p>{LONG}</p></div>'
    body = f"<h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    want = "\n".join(["Title"] + [LONG] * 4)
    for start, end in (("<div class='content has-sidebar'>", "</div>"), ("<div id='legal-article'><article>", "</article></div>"),
                       ("<form id=aspnet>", "</form>"), ("<div class=widget-area><main>", "</main></div>"),
                       ("<article><div class=has-sidebar>", "</div></article>"), ("<span class=share-page>", "</span>")):
        assert main_text(f"<body>{start}{body}{end}{rest}</body>") == want, start
    assert main_text(f"<body><article>{body}</article><div class=comments>" + f"<article><p>{LONG}</p></article>" * 9 + "</div></body>") == want
    assert main_text(f"<body><form style='display:none'>{body}</form><p>Seen.</p></body>") == "Seen."


def test_odd_markup():
    assert main_text("") == ""
    assert main_text("<html><body></body></html>") == ""
    assert main_text("plain text only, no tags.") == "plain text only, no tags."
    assert main_text('<p title="a > b">One, two. <i>three</i></p><p>1 < 2 & 3') == "One, two. three\n1 < 2 & 3"
    assert main_text("<article><p>cut in a tag, yes.</p><p cla") == "cut in a tag, yes."
    assert main_text("<article><p>kept, here.</p><script>never ends <p>no") == "kept, here."
    deep = "<div>" * 3000 + "<p>Deep, but there.</p>"
    assert main_text(deep) == "Deep, but there."


def test_elements_that_never_end():
    for broken in ("<svg><path d='M0'>", "<select><option>one<option>two", "<svg><g><text>label", "<iframe src=x>", "<noembed>"):
        assert main_text(f"<article><p>{LONG}</p>{broken}<p>{LONG}</p><p>Last.</p></article>") == f"{LONG}\n{LONG}\nLast.", broken
        assert main_text(f"<article><p>{LONG} {broken}</p><p>{LONG}</p></article>").startswith(LONG), broken
    for broken in ("<svg><path d='M0'>", "<select><option>one", "<object><param name=a>x", "<noscript>please", "<template><b>t"):
        assert main_text(f"<article><div><p>{LONG} {broken}</p></div><p>Second. {LONG}</p></article>") == f"{LONG}\nSecond. {LONG}", broken
    assert main_text(f"<article><svg><foreignObject><p>In a drawing.</p></foreignObject></svg><p>{LONG}</p></article>") == LONG
    assert main_text(f"<article><p>{LONG}</p><script>var a = '<p>no</p>'") == LONG


def test_a_sentence_stays_one_block():
    math = "<math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><mn>1</mn></mrow></math>"
    assert main_text(f"<article><p>So {math} holds, here. {LONG}</p></article>") == f"So x2+1 holds, here. {LONG}"
    noted = "<math><semantics><mi>y</mi><annotation encoding=tex>y_0</annotation></semantics></math>"
    assert main_text(f"<article><p>So {noted} holds, here. {LONG}</p></article>") == f"So y holds, here. {LONG}"
    for between in ("<script>var a;</script>", "<svg><title>i</title><g><path d=x></g></svg>", "<img src=a alt=b>", "<template><p>t</p></template>",
                    "<select><option>a</select>", "<style>p{}</style>", "<noscript><img src=a></noscript>"):
        assert main_text(f"<article><p>Before {between}and after. {LONG}</p></article>") == f"Before and after. {LONG}", between
    assert main_text(f"<article><p>{LONG}<hr>After.</article>") == f"{LONG}\nAfter."


def test_rows(spark):
    rows = [(1, "u", PAGE, "x", 5), (2, None, None, "y", 6), (None, "v", "", "z", 7), (1, "u", PAGE, "x", 5), (3, "w", "<p>" + "word, " * 200_000, "", 1)]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    assert sorted([(r["page_id"], r["url"], r["text"][:200], r["n_chars"]) for r in got], key=str) == sorted(
        [(1, "u", TEXT[:200], len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", ("word, " * 40)[:200], 1_199_999)], key=str)
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
