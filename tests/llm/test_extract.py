"""Main text of hand-made pages."""

from subledger.llm.extract import extract_pages, main_text

LONG = "The house was old and the garden was full of trees that had been there for as long as anyone could tell, and it is still so."


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{x}}</style><script>if (a < b) document.write("</p>")</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- gone --><div class="ad">Buy the best of it.</div>
    <article class="has-sidebar"><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Short &lt;b&gt; one,<br>two&nbsp;three.<b>bo</b>ld
    <aside>an aside of the page</aside><ul><li>first<li>second</ul><form>mail <input></form>
    <h2>Related</h2><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>
    <section id="comments"><article><p>{LONG}</p></article></section></article><footer>(c) us</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Title & more", LONG, "Short <b> one, two three.bold", "first", "second"]


def test_page_without_marked_article():
    page = f"""<body><div class="topbar">Welcome</div><div id=main-content class="with-sidebar"><h1>Head</h1><p>{LONG} {LONG}</p><p>Short.</p><p>{LONG} {LONG}</p></div>
    <div class="sidebar"><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG}</p></div><div><a href=1>{LONG}</a></div><p>xq zv kw jj qq zz xx vv ww kk</p></body>"""
    assert main_text(page).split("\n\n") == ["Head", f"{LONG} {LONG}", "Short.", f"{LONG} {LONG}"]


def test_unmarked_page_in_an_unlisted_language():
    russian = "Старый дом стоял на краю деревни, и в саду росли высокие деревья, которые помнили ещё прежних хозяев этого места."
    polish = "Stary dom stał przy drodze, obok rosły wysokie drzewa, które pamiętały jeszcze dawnych właścicieli tego miejsca."
    chinese = "老房子坐落在村庄的边缘，花园里长满了高大的树木，这些树木已经在那里生长了很多年，村里的人都记得它们。"
    menu = '<ul class="menu"><li><a href=1>Menu</a></li></ul>'
    for text in (russian, polish, chinese):
        page = f"{menu}<div><h1>{text[:9]}</h1><p>{text}</p><p>{text[:20].strip()}</p><p>{text}</p></div><div class=footer>{text}</div>"
        assert main_text(page).split("\n\n") == [text[:9].strip(), text, text[:20].strip(), text]
        # one English notice does not make the stop words fit the page
        assert main_text(f"{menu}<div>" + f"<p>{text}</p>" * 8 + f"</div><p>{LONG}</p>").count(text) == 8


def test_long_text_without_stop_words_takes_its_neighbours_label():
    code = "double total = sum(row.amount * row.price); printf(total); return total / rows.length; double mean = total;"
    page = f"<div><p>{LONG}</p><pre>{code}</pre><p>{LONG}</p></div><div class=ad>x</div><pre>{code}</pre><div class=ad>x</div>"
    assert main_text(page).split("\n\n") == [LONG, code, LONG]


def test_short_blocks_of_an_unmarked_page():
    read = "Read <a href=1>the full report</a> published on Monday."
    page = f"<div><p>{LONG}</p><p>{read}</p><p>{LONG}</p></div><div><p><a href=1>all links here</a></p></div>"
    assert main_text(page).split("\n\n") == [LONG, "Read the full report published on Monday.", LONG]
    lines = ["Who is there?", "Nobody.", "Then come in, nobody."]
    poem = "<p>".join(lines)
    assert main_text(f"<p>{poem}").split("\n\n") == lines
    menu = '<ul class="menu"><li><a href=1>Menu</a></li></ul>'
    assert main_text(f"{menu}<div><p>{poem}</p></div><footer>{lines[0]}</footer>").split("\n\n") == lines
    # nothing but menus and links stays empty
    assert main_text(f"{menu}<p><a href=1>all links here</a></p><footer>{lines[0]}</footer>") == ""


def test_wrappers_of_the_article_are_not_excluded():
    assert main_text(f'<form id=f><div class="notice"><main><p>{LONG}</p></main></div></form>') == LONG


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html>") == main_text("<!-- open") == ""
    assert main_text(f"<article><p>{LONG} a < b &am &amp c <") == f"{LONG} a < b &am & c <"
    assert main_text(f"<article><p>{LONG}</div></span></p><p title='a>b'>{LONG}</article>") == f"{LONG}\n\n{LONG}"
    assert len(main_text("<article>" + f"<p>{LONG}" * 5000)) == 5000 * len(LONG) + 2 * 4999


def test_hostile_nesting_is_linear():
    n = 30_000
    deep = "<div class=menu>" * n + "x" + "</span></p></td>" * n + "<li>" * n + "<article>" + f"<p>{LONG}"
    assert main_text(deep) == ""
    assert main_text("<div><form>" * n + f"<article><p>{LONG}</article>" + "</i>" * n) == LONG


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}é</article>"), (1, "u", f"<article><p>{LONG}é</article>"), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted((tuple(r) for r in extract_pages(df).collect()), key=str)
    want = [(1, "u", LONG + "é", len(LONG) + 1)] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    assert got == sorted(want, key=str)
    assert extract_pages(df.limit(0)).collect() == []
