import html
import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from loadscope.llm import html_extract as H

SCHEMA = "page_id bigint, url string, html string"

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href="/x">Menu entry</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="content-with-sidebar"><div class="post post-%d"><h1>A &amp; B</h1><p>First   <b>bold</b>er
paragraph&nbsp;here, with <a href="#">a link</a> in it.<p>Second &lt;one&gt; without end<br>and a break<ul><li>item one<li>item two</ul>
<div class="ad-slot">Buy now</div><form><p>Your name</p></form></div>
<aside>Related things that are quite long to read and more and more</aside>
<div id="comments"><p>First comment by a reader, long enough to count for something.</p></div></div>
<footer>&copy; somebody</footer></body></html>"""

WANT = "A & B\nFirst bolder paragraph here, with a link in it.\nSecond <one> without end and a break\nitem one\nitem two"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("_host2", F.lit(1))


def result(df):
    return {r.page_id: (r.url, r.text, r.n_chars) for r in df.collect()}


def test_article_without_the_rest(spark):
    rows = [(k, f"http://www.a.example/{k}", ARTICLE % k) for k in range(5)]
    got = result(H.extract(frame(spark, rows)))
    assert got == {k: (u, WANT, len(WANT)) for k, u, _ in rows}


def test_host_vote_corrects_a_single_page(spark):
    page = "<body><div class='story'><p>%s</p></div><div class='box'><p>%s</p></div></body>"
    rows = [(k, "https://b.example/x", page % ("story text " * 20, "box")) for k in range(6)]
    rows.append((6, "https://b.example/y", page % ("short story", "a long box text " * 30)))
    rows.append((7, "https://other.example/y", page % ("short story", "a long box text " * 30)))
    got = result(H.extract(frame(spark, rows)))
    assert got[6][1] == "short story" and got[7][1] == " ".join(("a long box text " * 30).split())


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "nonsense", "plain text &eacute; <b>only"), (4, "http://c.example", "<p>a<p>b</div></p>c<!-- x > --> <script>"),
        (5, "http://c.example", "<article><p>x" + " y" * 200_000), (5, "http://c.example", "<article><p>x"), (None, "http://c.example", "<p>q"),
    ]
    got = result(H.extract(frame(spark, rows)))
    assert got[1] == (None, "", 0) and got[2] == ("", "", 0) and got[3][1] == "plain text é only" and got[4][1] == "a\nb\nc"
    assert len(H.extract(frame(spark, rows)).collect()) == 7
    assert H.extract(frame(spark, []))  .collect() == []


def test_given_pages_round_trip(spark, sf_dir):
    """The given pages hold an article element of a heading and paragraphs; nothing else of them is extracted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for i, (_, text, n) in result(H.extract(pages)).items():
        body = sources[i].split("<article>")[1].split("</article>")[0]
        parts = [p for p in body.replace("</h1>", "<p>").replace("<h1>", "").replace("</p>", "").replace("<b>", "").replace("</b>", "").replace("<br>", " ").split("<p>")]
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert text == "\n".join(w for w in want if w) and n == len(text)


def test_headline_and_lead_beside_the_body_div(spark):
    body = "".join(f"<p>{'long paragraph ' * 20}{k}</p>" for k in range(6))
    want = ["Headline", "The lead.", *[("long paragraph " * 20) + str(k) for k in range(6)]]
    inner = f"<h1>Headline</h1><p>The lead.</p><div class='entry'>{body}</div>"
    parts = f"<section><p>one</p></section><section>{body}</section><blockquote>said</blockquote><table><tr><td>cell</td></tr></table>"
    shapes = [f"<body><nav><a>x</a></nav><article>{inner}</article></body>", f"<body><div class='post'>{inner}</div><div class='box'>box</div></body>", f"<body><main>{inner}</main></body>"]
    for n, shape in enumerate(shapes):
        got = result(H.extract(frame(spark, [(k, f"http://h{n}.example/{k}", shape) for k in range(3)])))
        assert all(text.split("\n") == want for _, text, _ in got.values())
    got = result(H.extract(frame(spark, [(1, "http://p.example", f"<body><article>{parts}</article></body>")])))
    assert got[1][1].split("\n") == ["one", *want[2:], "said", "cell"]


def test_winner_does_not_cut_a_page_that_has_more_beside_it(spark):
    entry = "<div class='entry'><p>%s</p></div>" % ("text " * 80)
    rows = [(k, "http://q.example/x", f"<body><div class='post'>{entry}</div></body>") for k in range(4)]
    rows.append((9, "http://q.example/y", f"<body><div class='post'><h1>Headline</h1>{entry}</div></body>"))
    assert result(H.extract(frame(spark, rows)))[9][1].startswith("Headline\ntext")


NAMES = ["discussion", "related-work", "social-impact", "legal-analysis", "search", "notice", "alert", "skip-lists", "share-of-costs", "comments-on-method"]


def test_sections_whose_ids_are_titles(spark):
    rows, want = [], []
    for tag in ("section", "div", "h2", "p"):
        for n, name in enumerate(NAMES):
            parts = [f"<p>{'some words ' * 9}{k}</p>" for k in range(6)]
            parts[3] = f"<{tag} id='{name}'>{'mid ' * 9}</{tag}>" if tag in ("h2", "p") else f"<{tag} id='{name}'><h2 id='{name}-2'>T</h2><p>{'mid ' * 9}</p></{tag}>"
            text = ["some words " * 9 + str(k) for k in range(6)]
            text[3] = ("" if tag in ("h2", "p") else "T\n") + ("mid " * 9).strip()
            if n % 2:  # at the end, and last in the page
                parts.append(parts.pop(3))
                text.append(text.pop(3))
            for outer in ("<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>"):
                rows.append((len(rows), f"http://{len(rows)}.example", f"<body><nav>n</nav>{outer % ''.join(parts)}<footer>f</footer></body>"))
                want.append("\n".join(text))
    got = result(H.extract(frame(spark, rows)))
    assert [got[k][1] for k in range(len(rows))] == want


def test_furniture_in_an_article_by_a_second_sign(spark):
    text = "<p>%s</p>" % ("some words " * 9)
    boxes = [
        "<div class='related'><h3>More</h3><ul><li><a href='/a'>one two three</a><li><a href='/b'>four</a></ul></div>", "<div class='ad-slot'>Buy now</div>",
        "<div class='cookie-notice'>We use them</div>", "<div id='search'><form><input name='q'></form>Find</div>", "<div role='alert'>Hear</div>",
    ]
    tail = "<div class='share'>Tell others</div><section id='comments'><h2>2 comments</h2><p>I do not think so at all.</p></section>"
    rows = [(k, f"http://{k}.example", f"<body><article>{text}{box}{text}{tail}</article></body>") for k, box in enumerate(boxes)]
    want = "\n".join([("some words " * 9).strip()] * 2)
    assert [t for _, t, _ in result(H.extract(frame(spark, rows))).values()] == [want] * len(boxes)


def test_quotes_in_values_without_quotes_and_open_objects(spark):
    pages = [
        "<article><p title=it's>First words.</p><p>Second words.</p></article>",
        "<article><p>First words.</p><img alt=Don't src=x><p>Second words.</p></article>",
        "<article><p>First words.</p><object data=x><p>Second words.</p></article>",
        '<article><p title="a > b">First words.</p><p title = \'c > "d\'>Second words.</p></article>',
    ]
    got = result(H.extract(frame(spark, [(k, f"http://q{k}.example/", "<html><body>" + p + "</body></html>") for k, p in enumerate(pages)])))
    assert {k: v[1] for k, v in got.items()} == {k: "First words.\nSecond words." for k in range(len(pages))}


def test_tags_that_never_end_take_linear_time():
    start = time.process_time()
    H.parse("<p " + '="x" ' * 20_000 + "<p>word")
    assert time.process_time() - start < 10


def test_unnamed_lead_beside_the_body_div(spark):
    body = "".join(f"<p>{'long paragraph ' * 20}{k}</p>" for k in range(4))
    want = "\n".join(["lead paragraph", *[("long paragraph " * 20) + str(k) for k in range(4)]])
    got = result(H.extract(frame(spark, [(k, "http://lead.example/", f"<body><div>lead paragraph</div><div class='body'>{body}</div></body>") for k in range(3)])))
    assert {t for _, t, _ in got.values()} == {want}


def test_text_of_formulas_drawings_and_field_sets(spark):
    page = """<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><p>An <svg class="icon"><title>t</title><g><path d="M0"/></g>
    <text>left</text><text>right</text></svg> drawing.</p><fieldset><legend>Legend</legend><p>In a set.</p></fieldset><form><fieldset>asked</fieldset></form></article></body>"""
    assert result(H.extract(frame(spark, [(1, "http://m.example/", page)])))[1][1] == "Let x=1 be.\nAn left right drawing.\nLegend\nIn a set."


def test_deep_pages_take_linear_time():
    for odd in ("<div>%d", "<div class='note'>%d<h1>h</h1>", "<li><div>%d", "<div><span hidden>x</i>%d"):
        start = time.process_time()
        page = H.parse("<body>" + "".join(odd % k for k in range(20_000)) + "</x>" * 20_000)
        H.best_path(page)
        H.text_at(page, "/body")
        assert time.process_time() - start < 10


class Plain(HTMLParser):
    """Text of an article by the standard parser: blocks end where a tag of a block starts or ends."""

    def __init__(self):
        super().__init__()
        self.inside = self.away = 0
        self.blocks, self.piece = [], []

    def cut(self):
        text = " ".join("".join(self.piece).split())
        self.blocks += [text] * bool(text)
        self.piece = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.away += tag in AWAY
        if tag == "br":
            self.piece.append(" ")
        elif tag not in SPANS:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in SPANS and tag != "br":
            self.cut()
        self.inside -= tag == "article"
        self.away -= tag in AWAY

    def handle_data(self, data):
        if self.inside and not self.away:
            self.piece.append(data)


AWAY, SPANS = {"nav", "aside", "form", "script", "style"}, {"b", "i", "a", "span", "sub", "math", "mi", "code"}


def grown(rng, depth=0):
    """Random closed elements with text, in and out of blocks."""
    words = lambda: " ".join(rng.choice(["one", "two &amp; three", "&lt;four&gt;", "f\u00fcnf", "six &#55;", "  eight\n"]) for _ in range(rng.randrange(1, 6)))
    spans = lambda: "".join(rng.choice([words(), f"<b>{words()}</b>", f"<span class='x{rng.random()}'>{words()}</span>", "<br>", f"<math><mi>{words()}</mi></math>"]) for _ in range(3))
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "h2", "li", "div", "section", "blockquote", "table", "fieldset", "nav", "aside", "form", "script"])
        inner = grown(rng, depth + 1) if kind in ("div", "section", "blockquote", "fieldset") and depth < 5 else "x" if kind == "script" else spans()
        parts.append({"li": f"<ul><li>{inner}</li><li>{spans()}</li></ul>", "table": f"<table><tr><td>{inner}</td><td>{spans()}</td></tr></table>"}.get(kind, f"<{kind}>{inner}</{kind}>"))
    return "".join(parts) + words()


def test_generated_articles_like_the_standard_parser(spark):
    rng = random.Random(6)
    rows = [
        (k, f"http://{k % 7}.example/{k}", f"<body><header>Site</header><nav>menu</nav><article>{grown(rng)}<p>{'some words ' * 30}</p></article><footer>end</footer></body>")
        for k in range(300)
    ]
    got = result(H.extract(frame(spark, rows)))
    for k, _, page in rows:
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert got[k][1] == "\n".join(plain.blocks), page
