"""What isn't template stays: rare subtrees of large hosts, parts of articles, and scripts end where they end."""

import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

from tracelake.llm import html_text


def extracted(spark, pages):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_a_share_of_the_hosts_pages(spark):
    quoted = lambda k: "<div>Quoted by some</div>" if k % 20 == 0 else ""
    pages = [(k, f"http://big.example/{k}", f"<body><div>Slogan</div>{quoted(k)}<p>text {k}</p></body>") for k in range(120)]
    pages += [(200 + k, f"http://small.example/{k}", f"<body><div>Quoted by some</div><p>text {k}</p></body>") for k in range(6)]
    pages += [(300 + k, f"http://mixed.example/{k}", f"<body>{'<div>Rare</div>' if k < 5 else ''}text {k}</body>") for k in range(100)]
    got = extracted(spark, pages)
    assert got[1] == "text 1" and got[20] == "Quoted by some\n\ntext 20"  # on 6 of 120 pages
    assert got[203] == "text 3"  # on 6 of 6
    assert got[302] == "Rare\n\ntext 2"  # pages without any subtree count too


def test_nothing_of_an_article(spark):
    parts = "<ul><li>one</li></ul><table><tr><td>two</td></tr></table><figure>three</figure><div class='share'>Share this</div>"
    pages = [(k, f"http://h.example/{k}", f"<body><div>Slogan</div><article><p>text {k}</p>{parts}</article></body>") for k in range(8)]
    got = extracted(spark, pages)
    assert got[3] == "text 3\n\none\n\ntwo\n\nthree"


def test_capital_i_with_a_dot():
    page = "<body><p>" + "İ" * 40 + "</p><SCRIPT>var x = '<p>no</p>'</Script><p>yes it is</p><style>p {}</style><p>end</p></body>"
    assert html_text.main_text(page) == "İ" * 40 + "\n\nyes it is\n\nend"


def marked_subtrees(page):
    """By brute force, for well-formed pages without entities: the containers of a page as (tag, what they are made of)."""
    out = []

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack = [("", [])]

        def handle_starttag(self, tag, attrs):
            self.stack.append((tag, []))

        def handle_data(self, data):
            if data.strip():
                self.stack[-1][1].append(" ".join(data.split()))

        def handle_endtag(self, tag):
            name, made = self.stack.pop()
            if made:
                self.stack[-1][1].append((name, tuple(made)))
                if name in html_text.CONTAINERS:
                    out.append((name, tuple(made)))

    reader = Reader()
    reader.feed(page)
    return tuple(reader.stack[0][1]), set(out)


def random_page(rng, parts):
    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{rng.choice(parts)}</p>"
        tag = rng.choice(["div", "section", "ul", "p"])
        if tag == "p":
            return f"<p>{rng.choice(parts)} {rng.random() if rng.random() < 0.3 else ''}</p>"
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<{tag}>" + (f"<li>{inner}</li>" if tag == "ul" else inner) + f"</{tag}>"

    return "<body>" + "".join(tree(3) for _ in range(rng.randint(1, 4))) + "</body>"


def test_counts_by_host(spark):
    """The template of each host against a count by brute force, with copies of pages, on pages without a marked article."""
    rng = random.Random(5)
    parts = ["one", "two words", "three words here", "and four words here"]
    hosts = ["a.example", "b.example", ""]
    pages = [(k, f"http://{h}/{k}" if h else None, random_page(rng, parts)) for k in range(120) for h in [rng.choice(hosts)]]
    pages += [(200 + k, *pages[3][1:]) for k in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    seen, of_host = defaultdict(set), defaultdict(set)
    for _, url, page in pages:
        host = url.split("/")[2] if url else ""
        whole, own = marked_subtrees(page)
        of_host[host].add(whole)
        for tree in own:
            seen[host, tree].add(whole)
    want = Counter(h for (h, _), p in seen.items() if len(p) >= 5 and len(p) >= 0.1 * len(of_host[h]))
    rows = frame.selectExpr("unhex(md5(html)) key", "coalesce(split_part(url, '/', 3), '') host", "html")
    found = rows.mapInArrow(html_text._find_subtrees, "key binary, host string, page long, tree long")
    got = Counter(r.host for r in html_text.template_of(found).collect())
    assert got == want and sum(want.values()) >= 5
    template = {(h, t) for (h, t), p in seen.items() if len(p) >= 5 and len(p) >= 0.1 * len(of_host[h])}

    def text(page, host):
        whole, _ = marked_subtrees(page)

        def blocks(made):
            for x in made:
                if isinstance(x, str):
                    yield x
                elif (host, x) not in template:
                    yield from blocks(x[1])

        return "\n\n".join(blocks(whole))

    texts = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    assert texts == {k: text(page, url.split("/")[2] if url else "") for k, url, page in pages}
    assert sum(len(t) for t in texts.values()) < sum(len(html_text.main_text(p)) for _, _, p in pages)


def test_what_fixed_rules_leave():
    text = "Hello world, this stays on the page."
    assert html_text.main_text(f"<form action=x><nav>menu</nav><div><p>{text}</p><button>Go <b>on</b></button><label>Name</label></div></form>") == text
    assert html_text.main_text(f"<p>{text}</p><form><p>Search</p><input></form>") == text
    assert html_text.main_text(f"<div class='post share-enabled'><p>{text}</p></div>") == text
    assert html_text.main_text(f"<div class='sidebar'><article><p>{text}</p></article></div>") == text
    assert html_text.main_text(f"<div class='comments'><article><p>no</p></article></div><p>{text}</p>") == text
    assert html_text.main_text(f"<p>{text}<button>left open") == text + "left open"
    assert html_text.main_text("İ" * 30 + f"<script>x</script><p>{text}</p>") == "İ" * 30 + "\n\n" + text


def test_long_and_deep_pages(spark):
    deep = "<div>t " * 5000 + "</div>" * 5000
    assert html_text.main_text(deep).count("t") == 5000 and len(html_text.subtrees(deep)[2]) == 5000
    assert html_text.main_text("<div>t " * 5000 + "</section>" * 5000).count("t") == 5000
    long = "<p>" + "word " * 400_000 + "</p>"
    pages = [(1, "u", long, "x", "y", "z"), (2, "u", "", "x", "y", "z"), (2, "u", "", "x", "y", "z")]
    got = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string, key string, gone string, text string"))
    assert got.columns == ["page_id", "url", "text"] and sorted((r.page_id, len(r.text)) for r in got.collect()) == [(1, 1_999_999), (2, 0), (2, 0)]


def test_no_text_is_lost_to_quotes_formulas_or_teasers():
    assert html_text.main_text("<article><p>one</p><p data-x=it's>two</p><p>three</p></article>") == "one\n\ntwo\n\nthree"
    assert html_text.main_text("<p title = 'a > b'>one</p><p title=\"c > d\">two</p><p 'x>three</p><p a='>left open") == "one\n\ntwo\n\nthree"
    assert html_text.main_text("Let <math><mi>x</mi><annotation>\\x</annotation></math> hold.") == "Let x hold."
    assert html_text.main_text("<main><h1>Title</h1><article><p>body</p></article><p>more</p></main><p>out</p>") == "Title\n\nbody\n\nmore"
    assert html_text.main_text("<article>teaser</article><p>the long text beside it</p>") == "teaser\n\nthe long text beside it"
    assert html_text.main_text("<p>beside</p><article>the long text of the article</article>") == "the long text of the article"
    assert html_text.main_text("<p a" + "='x" * 50_000) == "" and html_text.main_text("<p " + "= " * 50_000 + ">t") == "t"


def test_template_decides_where_an_article_is_a_teaser(spark):
    """Pages of one host share a menu as long as their article: what the template leaves is held by the article."""
    menu = "<div><ul><li>" + "</li><li>".join(f"Section number {k}" for k in range(12)) + "</li></ul></div>"
    pages = [(k, f"http://a.example/{k}", f"<body>{menu}<article><p>Story {k} " + f"word{k} " * 9 + "</p></article></body>") for k in range(12)]
    assert not any(html_text.subtrees(p)[1] for _, _, p in pages)
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} " + " ".join([f"word{k}"] * 9) for k in range(12)}
