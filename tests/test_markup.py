"""Text, markdown and link extraction on literal markup."""

from html.parser import HTMLParser

import pytest

from pagemill.functions import links, markup


class TextOf(HTMLParser):
    """Words of a page, by the standard parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.quiet, self.words = 0, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.quiet:
            self.words += data.split()


TEXTS = [
    ("<p>a</p><p>b</p>", "a\nb"),
    ("<p>a <b>b</b> <i>c</i>d</p>", "a b cd"),
    ("a<br>b", "a\nb"),
    ("<b>never closed <p>next", "never closed\nnext"),
    ("<p><!-- <script> --> kept <script>var s=\"<!-- \";</script> also <!-- c --> end", "kept also end"),
    ("<head><title>T</title></head><body>x", "x"),
    ("<head><title>T<body>x", "x"),
    ("<header>kept</header>", "kept"),
    ("<style>p{}</style>x", "x"),
    ("x<script>cut off", "x"),
    ("&lt;b&gt; &amp;lt; &eacute; &#8364; &#x20AC; &#128; &bogus; &copy", "<b> &lt; é € € € &bogus; &copy"),
    ("&#0;|&#xD800;|&#x110000;", "\ufffd|\ufffd|\ufffd"),
    ("&#38;amp; &#38;lt;", "&amp; &lt;"),
    ("a&nbsp;b", "a b"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p title=it's>odd quote</p>", "odd quote"),
    ("<p title=\"a > b\">quoted</p>", "quoted"),
    ("", ""),
    (None, None),
]


def test_page_text(apply):
    assert apply(markup.page_text, [(h,) for h, _ in TEXTS]) == [t for _, t in TEXTS]


MARKDOWN = [
    ("<h1>One</h1><h3 class=x>Three</h3>t", "# One\n\n### Three\n\nt"),
    ("<ul><li>a<li>b</ul>c", "* a\n  * b\n\nc"),
    ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    ("a<br>b", "a  \nb"),
    ("<b>b</b> <em>e</em> <code>c</code> <del>d</del>", "**b** _e_ `c` ~~d~~"),
    ("<a href=\"/x?a=1&amp;b=2\">l <b>k</b></a>", "[l **k**](/x?a=1&b=2)"),
    ("<a class=x href='y'>z</a> <a href=q>u</a>", "[z](y) [u](q)"),
    ("<a href=\"#top\">up</a>", "up"),
    ("<a name=x>anchor</a>", "anchor"),
    ("<img src=a.png alt=pic>text", "text"),
    ("<blockquote>said</blockquote>", "> said"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "a | b\nc | d"),
    ("<b>open", "**open"),
]


STRUCTURES = [
    ("<ol><li>a</li><li>b</li></ol>c", "1. a\n  2. b\n\nc"),
    ("x<ol start=7><li>a<li><p>b</p></ol>", "x\n\n  7. a\n  8. b"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>d", "* a\n    * b\n  * c\n\nd"),
    ("t<ul><li>a<ol><li>b</li><li>c<ul><li>d</li></ul></li></ol></li></ul>", "t\n\n  * a\n    1. b\n    2. c\n      * d"),
    ("<p>t</p><ul><li><ul><li>in</li></ul></li></ul>", "t\n\n  *\n    * in"),
    ("<p>t</p><pre>x = 1\n  y = 2\n\n\tz</pre><p>u  v</p>", "t\n\n    x = 1\n      y = 2\n    \n    \tz\n\nu v"),
    ("<pre>\n<code class=\"py\">a  &lt; b\n</code>\n</pre>c <code>d</code>", "    a  < b\n\nc `d`"),
    ("<pre>never\n closed", "    never\n     closed"),
    ("<blockquote><p>a</p><p>b</p></blockquote>c", "> a\n> \n> b\n\nc"),
    ("<blockquote>a<blockquote><p>b</p></blockquote>c</blockquote>", "> a\n> \n>> b\n> \n> c"),
    ("<blockquote><ul><li>a</li><li>b</li></ul><pre>p\n q</pre></blockquote>", ">   * a\n>   * b\n> \n>     p\n>      q"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td>d</td></tr></table>e", "a | b\n---|---\nc | d\n\ne"),
    ("<table><tr><th>k</th><td>v</td></tr><tr><th>l</th><td>w</td></tr></table>", "k | v\n---|---\nl | w"),
    ("<table><tr><td>c</td></tr><tr><th>a</th></tr></table>", "c\na"),
    ("</ul></ol></li><ol></blockquote></pre><li>x", "1. x"),
]


def test_structures(apply):
    assert apply(markup.page_markdown, [(h,) for h, _ in STRUCTURES]) == [m for _, m in STRUCTURES]


def test_structured_and_flat_pages_read_alike(apply):
    """Where nothing is nested both ways of reading give the same."""
    rows = [(h,) for h, _ in MARKDOWN if "blockquote" not in h]
    assert apply(markup._structured_markdown, rows) == apply(markup._flat_markdown, rows)


def test_a_page_of_many_items(apply):
    n = 3000
    html = "<ol>" + "".join(f"<li>i{k}<ul><li>j</li></ul></li>" for k in range(n)) + "</ol>"
    want = "\n".join(f"  {k + 1}. i{k}\n    * j" for k in range(n))[2:]
    assert apply(markup.page_markdown, [(html,)]) == [want]


def test_page_markdown(apply):
    assert apply(markup.page_markdown, [(h,) for h, _ in MARKDOWN]) == [m for _, m in MARKDOWN]


def test_text_has_the_words_of_the_standard_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in pages.select("html", markup.page_text("html" and pages["html"]).alias("t")).collect():
        assert "".join(row["t"].split()) == "".join(TextOf(row["html"]).words)


BLANK = [
    (None, True), ("", True), ("<p> &nbsp; </p>", True), ("<script>x</script>", True), ("<!-- x -->", True),
    ("<head><title>t</title></head><body></body>", True), ("<p>x</p>", False), ("x", False),
    ("<p>&eacute;</p>", False), ("<a href='/x'></a>", False), ("<img src=x>", True), ("<hr>", False),
]


def test_blank(apply):
    rows = [(h,) for h, _ in BLANK]
    wanted = [b for _, b in BLANK]
    assert apply(lambda h: markup.is_blank(markup.page_markdown(h)), rows) == wanted
    assert apply(markup.is_blank_page, rows) == wanted


@pytest.mark.parametrize(
    "provider, chars",
    [("mistral", 96_000), ("openai", 300_000), ("groq", 24_000), ("gemini", 300_000), ("ollama", 24_000),
     ("else", 96_000), (None, 96_000)],
)
def test_context(apply, provider, chars):
    assert markup.context_chars(provider) == chars
    got = apply(lambda t: markup.within_context(t, provider), [("é" * (chars + 5),), ("short",)])
    assert [len(g) for g in got] == [chars, 5]


HREFS = [
    ('<a title="a>b" href="/1">1</a><!--<a href="/2">--><A HREF=/3 x>3</a><a data-href="/no">n</a>', ["/1", "/3"]),
    ("<script>'<a href=\"/no\">'</script><a\nhref = '/4'>", ["/4"]),
    ("<a href='  /5\n '>", ["/5"]),
    ("<abbr href='/no'><area href='/no'>", []),
    ("<a href=''>", [""]),
    ("<a href=\"/ü?a&amp;b&quot;\">", ['/ü?a&b"']),
    (None, []),
]


def test_hrefs(apply):
    assert apply(links.hrefs, [(h,) for h, _ in HREFS]) == [l for _, l in HREFS]


ONCLICK = [
    ("<div onclick=\"window.open('/a/b')\">", ["/a/b"]),
    ("<td onclick='location.href=\"x.html\"'>", ["x.html"]),
    ("<td onclick=\"go('two words/x'); go('word')\">", []),
    ("<b onclick=\"a('p.htm');b(&quot;/q&quot;)\">", ["p.htm", "/q"]),
    ("<b data-onclick=\"a('/no')\">", []),
    ("<p>onclick=\"a('/no')\"</p>", []),
    (None, []),
]


def test_onclick(apply):
    assert apply(links.onclick_targets, [(h,) for h, _ in ONCLICK]) == [l for _, l in ONCLICK]


def test_page_links_join_both_kinds_and_honour_base(apply):
    html = "<base href='/dir/sub/'><a href='p'><a href='../q'><i onclick=\"go('r/s')\">"
    assert apply(links.page_links, [(html, "http://h/a/b"), (None, "http://h/")]) == [
        ["http://h/dir/sub/p", "http://h/dir/q", "http://h/a/r/s"], [],
    ]
