"""Main text of pages whose article is known."""

from __future__ import annotations

import html
import random
import re

from cyclograin.llm import html_text, queries


def expected(source):
    body = source[source.index("<article>") + 9 :]
    body = body.split("</article>")[0].replace("<br>", " ")
    blocks = re.split(r"</?(?:p|h1)[^>]*>", body)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_registered_query_gives_the_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.op5_main_text(spark, sf).collect():
        assert r["text"] == expected(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


FURNITURE = [
    '<nav><ul><li><a href="/a">{0}</a><li><a href="/b">{1}</a></ul></nav>',
    "<header><h1>{0}</h1></header>",
    '<div id="sidebar-left"><p>{0}</p></div>',
    "<aside>{0}<p>{1}</aside>",
    '<div class="cookie-notice">{0} {1}</div>',
    '<div class="ads top"><p>{0}</p></div>',
    "<form><label>{0}</label><input><textarea>{1}</textarea></form>",
    "<script>if (a < b) document.write('<p>{0}</p>')</script><style>p{{}}</style>",
    '<section class="comments"><article class="comment"><p>{0} {1} {0} {1}</p></article></section>',
    '<div role="navigation">{0}</div><!-- <p>{1}</p> -->',
    '<div style="display:none">{0}</div><footer>{1}</footer>',
]


def test_articles_between_furniture():
    rng = random.Random(4)
    for case in range(60):
        blocks = [sentence(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(2, 7))]
        marked = ["<h2>%s</h2>" % blocks[0]]
        marked += [rng.choice(["<p>%s</p>", "<p>%s", "<p><b>%s</b>", "<blockquote>%s</blockquote>"]) % b for b in blocks[1:]]
        pieces = [f.format(sentence(rng, 9), sentence(rng, 9)) for f in rng.sample(FURNITURE, 6)]
        if pieces[0].startswith("<header"):  # inside an article it would be the article's own
            pieces[0], pieces[1] = pieces[1], pieces[0]
        inner = "\n".join(marked[:2] + [pieces[0]] + marked[2:])
        wrap = ["<article>%s</article>", "<main><div class='post'>%s</div></main>", "<div class='wrap'><div class='post-body'>%s</div></div>"][case % 3]
        page = "<html><body>" + "".join(pieces[1:4]) + wrap % inner + "".join(pieces[4:]) + "</body></html>"
        assert html_text.main_text(page) == "\n".join(blocks), page


def test_frames_named_after_what_they_hold():
    rng = random.Random(6)
    blocks = [sentence(rng, 40) for _ in range(4)]
    body = "<div class='text'>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div>"
    side = '<div class="sidebar"><p>%s</p></div>' % sentence(rng, 9)
    for frame in ("page with-sidebar", "layout-with-sidebar", "no-ads", "sidebar-open", "header-wrap"):
        assert html_text.main_text(f'<body class="x"><div class="{frame}">{body}{side}</div></body>') == "\n".join(blocks), frame


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "only &lt;text&gt; &amp; more&nbsp;here"), (4, "<p>a<p>b"), (5, "<div>" * 50000 + "deep"), (6, "<p"), (7, "<a href='x>y</a>"), (8, "<ul><li>" * 3)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(docs, "html", ["page_id"]).collect()}
    assert got[1] == got[2] == "" and got[3] == "only <text> & more here" and got[4] == "a\nb" and got[5] == "deep" and len(got) == len(rows)
    assert html_text.extract(docs.limit(0), "html", ["page_id"]).count() == 0
    assert html_text.main_text("<article><header><h1>Head</h1><i>by me</i></header><p>one<br>two <i>th</i>ree</p></article>") == "Head\none two three"


def test_names_do_not_cut_running_text():
    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    inner = (
        f"<h2 id='related-work'>Related</h2><p>{a}</p><h2 id='search'>Searching</h2><p class='notice-period'>{b}</p>"
        f"<h2 class='section-header'>Part</h2><p>{c}</p><section id='discussion'><h3>Discussed</h3><p>{d}</p></section><section id='search-share'><p>{e}</p></section>"
        "<div id='share'><a href='/a'>one</a> <a href='/b'>two</a></div><div class='comments'><p>so long a reply</p></div>"
    )
    want = "\n".join(["Related", a, "Searching", b, "Part", c, "Discussed", d, e])
    for frame in ("<article>%s</article>", "<main><article>%s</article></main>", "<div class='text'>%s</div>"):
        assert html_text.main_text("<body>" + frame % inner + "</body>") == want, frame


def test_articles_side_by_side_and_nested():
    rng = random.Random(9)
    many, c, lead = [sentence(rng, 60) for _ in range(8)], sentence(rng, 90), sentence(rng, 60)
    first = "<article>" + "".join(f"<p>{p}</p>" for p in many) + "</article>"
    links = "<ul>" + "<li><a href='/a'>some link</a>" * 8 + "</ul>"
    page = f"<body><main><h1>Top</h1><p>{lead}</p>{first}<article><p>{c}</p></article>{links}</main></body>"
    assert html_text.main_text(page) == "\n".join(["Top", lead, *many, c])
    page = f"<body>{links}<article><h1>Top</h1><p>{lead}</p>{first}<article><p>{c}</p></article></article></body>"
    assert html_text.main_text(page) == "\n".join(["Top", lead, *many, c])
    page = f"<body>{links}{first}<article><p>{c}</p></article></body>"
    assert html_text.main_text(page) == "\n".join([*many, c])
