import collections
import html
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import pages as pg
from tests.conftest import SF_SMALL

SF_MORE = SF_SMALL.replace("sf0.001", "sf0.01")          # hosts of up to 29 pages


def wrap(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_marked_regions_and_blocks():
    body = """<header class="top"><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
      <div id="sidebar"><p>Side</p></div><main><article class="post"><header><h1>Head &amp; line</h1><p>By someone</p></header>
      <p>One <b>two</b>,<br>three<p>f&uuml;nf&nbsp;&#x1F642;<ul><li>a<li>b</ul><form><input><p>Name</p></form>
      <div class="ad">Buy</div><aside>more</aside><script>var x = "</p>";</script><!-- a <p>comment</p> --><p>last</p></article>
      <section id="comments"><article><p>First!</p></article></section></main><footer>&copy; us</footer>"""
    assert pg.main_text(wrap(body)) == "Head & line\n\nOne two, three\n\nfünf 🙂\n\na\n\nb\n\nlast"


def test_broken_and_empty_markup():
    assert pg.main_text("") == ""
    assert pg.main_text("<p>a<p>b") == "a\n\nb"
    assert pg.main_text("<article><p>a <b>b</p><p>c") == "a b\n\nc"
    assert pg.main_text("<article><p>a</p><script>never closed <p>x") == "a"
    assert pg.main_text("<article><p>1 < 2 & 3 > 2</p><!-- open <p>x") == "1 < 2 & 3 > 2"
    assert pg.main_text('<article><p title="a > b">x</p></article>') == "x"
    assert pg.main_text("<nav>a</nav>") == ""


def test_template_text_is_dropped_without_marks(spark):
    rows = []
    for i in range(40):
        body = (f"<div><p>Welcome to our good pages</p><p>Story {i} tells of {i * 7} ships and {i * 13} men at sea in words of its own</p>"
                f"<p>And a second paragraph number {i} that is not like the others at all, so it stays</p>"
                "<p>Read more of our stories every day of the week, only here with us</p></div>")
        rows.append((i, f"http://user@News.example.org:80/a/{i}", wrap(body, f"s{i}")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in pg.extract(df).collect()}
    for i in range(40):
        assert got[i].split("\n\n") == [f"Story {i} tells of {i * 7} ships and {i * 13} men at sea in words of its own",
                                        f"And a second paragraph number {i} that is not like the others at all, so it stays"]


def packed(*classes):
    return np.array([(rank, token) for rank, c in enumerate(classes) for token in c], np.int64).tobytes()


def test_class_order_decides_validity():
    t = pg.Template(packed((10, 11, 12), (20, 21)))
    assert t.valid([10, 5, 11, 7, 12]) == {0: [0, 2, 4]}
    assert t.valid([20, 10, 11, 12, 21]) == {0: [1, 2, 3], 1: [0, 4]}
    assert t.valid([10, 12, 11]) == {} and t.valid([10, 11]) == {} and t.valid([10, 11, 12, 10]) == {}


def test_classes_nest_in_one_gap():
    t = pg.Template(packed((10, 11, 12), (20, 21), (30, 31)))
    assert t.nested([10, 20, 5, 21, 11, 12]) == [0, 1, 3, 4, 5]
    assert t.nested([10, 20, 30, 31, 21, 11, 12]) == [0, 1, 2, 3, 4, 5, 6]
    assert t.nested([10, 20, 11, 21, 12]) == [0, 2, 4]                     # across a token of the first class
    assert t.nested([10, 20, 30, 21, 31, 11, 12]) == [0, 1, 3, 5, 6]       # across one of the second
    assert t.nested([20, 21]) == [0, 1] and t.nested([]) == []


def test_roles_tell_repeated_tokens_apart():
    a, b, c, d, e = pg.roles([7, 1, 7, 7, 2], [1])
    assert b == 1 and len({a, b, c, d, e}) == 5
    assert pg.roles([7, 1, 7, 7, 2], [1]) == [a, b, c, d, e] and pg.roles([7, 1, 7, 2], [1])[2] != c
    # containers 7 and 8 hold tokens of the tree: the same role whatever stands beside them
    one, two = pg.roles([7, 1, 8, 2], [1, 3], [-1, 0, -1, 2]), pg.roles([7, 1, 8, 8, 2], [1, 4], [-1, 0, -1, -1, 3])
    assert one[0] == two[0] and one[1] == two[1] and one[2] == two[3] != two[2]


def slot(words, *chain, varies=True, heading=False, fixed=False, number=1):
    return {"slot": number, "chain": list(chain), "words": words, "varies": varies, "heading": heading, "fixed": fixed}


def test_article_element():
    assert pg.article_element([]) is None and pg.article_element([slot(9, 1, varies=False)]) is None
    assert pg.article_element([slot(90, 1, 2), slot(9, 1, 3), slot(1, 1)]) == 2
    assert pg.article_element([slot(60, 1, 2), slot(40, 1, 3)]) == 1
    assert pg.article_element([slot(90, 1, 2, 3), slot(9, 1, 2, heading=True), slot(1, 1)]) == 2
    assert pg.article_element([slot(90, 1, 2, 3), slot(9, 1, 4, heading=True), slot(1, 1)]) == 3
    assert pg.article_element([slot(90, 1, ~2, 3), slot(9, 1, ~2)]) == ~2
    assert pg.article_element([slot(500, 1, 3, varies=False), slot(9, 1, 2), slot(1, 1)]) == 2


def classes_of(pages):
    """Classes by whole occurrence vectors: [(pages, tokens)] of one host's token lists."""
    vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
    groups = collections.defaultdict(set)
    for t, v in vectors.items():
        if max(v) == 1 and 2 * sum(v) >= len(pages) and sum(v) >= pg.MIN_PAGES:
            groups[v].add(t)
    return {(sum(v), frozenset(g)) for v, g in groups.items() if len(g) > 1}


def test_templates_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF_MORE}/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    parsed = pg.written(df.mapInArrow(pg._parsed, "id long, url string, host string, key long, article boolean, tokens binary, facts binary, "
                                                  "hashes binary, z binary"), "t_parsed")
    by_host = collections.defaultdict(list)
    for r in df.collect():
        page = pg.read(r["html"] or "")
        by_host[pg.host_of(r["url"])].append((page.tokens, page.within))
    base = pg.templates(parsed, "t_base").withColumnRenamed("packed", "base")
    got = {r["host"]: r["base"] for r in base.collect()}
    told = {r["host"]: r["packed"] for r in pg.templates(parsed.join(base, "host"), "t_full").collect()}
    assert set(got) == set(told) == {h for h, pages in by_host.items() if len(pages) >= pg.MIN_PAGES}
    for host, pages in by_host.items():
        if len(pages) >= pg.MIN_PAGES:
            first = pg.Template(got[host])
            second = [pg.roles(p, first.nested(p), within) for p, within in pages]
            for want, t in ((classes_of([p for p, _ in pages]), first), (classes_of(second), pg.Template(told[host]))):
                have = collections.defaultdict(set)
                for token, (rank, _) in t.order.items():
                    have[rank].add(token)
                assert {frozenset(c) for c in have.values()} == {c for _, c in want}


def test_template_finds_articles_without_marks(spark):
    """Marks renamed away: hosts with a template give the text that the marks gave."""
    df = spark.read.parquet(f"{SF_MORE}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"), '<div class="ad">', "<div>")
    want = {r["page_id"]: (pg.host_of(r["url"]), pg.main_text(r["html"] or "")) for r in df.collect()}
    sizes = collections.Counter(h for h, _ in want.values())
    got = {r["page_id"]: r["text"] for r in pg.extract(df.withColumn("html", plain)).collect()}
    large = [k for k, (h, _) in want.items() if sizes[h] >= pg.MIN_PAGES]
    assert len(large) > 50 and sum(got[k] == want[k][1] for k in large) >= 0.95 * len(large)
    assert not any(got[k] == want[k][1] for k in want if sizes[want[k][0]] < pg.MIN_PAGES)


def test_optional_regions_copies_and_cut_pages(spark):
    """A promotion on some pages, repeated rows and copies, and pages cut off leave the articles whole."""
    def page(i, cut=None):
        promo = f"<div><p>Offer {i} of the week is here</p></div>" if i % 3 else ""
        body = (f"<div><ul><li><a>Home</a></li><li><a>News {i}</a></li></ul></div>{promo}<div><h2>Head {i}</h2>"
                + "".join(f"<p>Paragraph {k} of story {i} has these words and {i * k} more of them to read</p>" for k in range(2 + i % 4))
                + f"</div><div>foot {i}</div>")
        return wrap(body, f"s{i}")[:cut]

    def text(i):
        return "\n\n".join([f"Head {i}"] + [f"Paragraph {k} of story {i} has these words and {i * k} more of them to read" for k in range(2 + i % 4)])

    rows = [(i, "http://h.org/" + str(i), page(i)) for i in range(30)]
    rows += [(100 + i, "http://h.org/" + str(i), page(1)) for i in range(200, 220)] + [(1, "http://h.org/1", page(1))] * 3
    rows += [(500, "http://h.org/cut", page(8, 300)), (501, "http://h.org/null", None)]
    rows += [(600 + i, "http://same.org/" + str(i), page(4)) for i in range(9)]
    got = collections.defaultdict(set)
    for r in pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect():
        got[r["page_id"]].add(r["text"])
    assert all(got[i] == {text(i)} for i in range(30)) and all(got[300 + i] == {text(1)} for i in range(20))
    assert got[501] == {""} and len(got) == 30 + 20 + 2 + 9
    # pages that do not vary have no slots to choose by, and are read by marks
    assert all(got[600 + i] == {pg.main_text(page(4))} for i in range(9))


def test_cases(spark):
    schema = "page_id long, url string, html string, host string, n int"
    rows = [(1, None, None, "x", 1), (2, "", "", "x", 1), (3, "not a url", wrap("<article><p>x</p></article>"), "x", 1), (None, "http://a.b/", "<p>y", "x", 1)]
    rows += [(7, "http://a.b/", wrap("<article>" + "<p>long one</p>" * 5000 + "</article>"), "x", 1)] * 2
    got = [(r["page_id"], r["url"], r["text"]) for r in pg.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted([(1, None, ""), (2, "", ""), (3, "not a url", "x"), (None, "http://a.b/", "y")]
                                           + [(7, "http://a.b/", "\n\n".join(["long one"] * 5000))] * 2, key=repr)
    assert pg.extract(spark.createDataFrame([], schema)).collect() == []


def test_query_equals_plain_reading(spark):
    from tessera.llm.catalog import QUERIES
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, SF_SMALL).collect()
    assert len(got) == len(raw)
    for r in got:
        body = re.search("<article>(.*?)(</article>|$)", raw[r["page_id"]], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_class_words_of_layouts_keep_the_article():
    for names in ("content has-sidebar", "no-sidebar", "right-sidebar", "post no-comments", "layout-side-by-side", "header_wrap", "related"):
        assert pg.main_text(wrap(f'<nav>n</nav><div class="{names}"><article><p>a</p></article><p>b</p></div>')) == "a"
        assert pg.main_text(wrap(f'<div id="{names}"><main><p>a</p></main></div><div class="ad">b</div>')) == "a"
        assert pg.main_text(wrap(f'<main><div class="{names}"><article><p>a</p></article></div></main>')) == "a"
    for names in ("article-form", "post no-comments", "has-sidebar"):
        assert pg.main_text(wrap(f'<article class="{names}"><p>a</p></article><p>b</p>')) == "a"
        assert pg.main_text(wrap(f'<main><p>i</p><article class="{names}"><p>a</p></article></main>')) == "i\n\na"
    # a wrapper without an article element
    assert pg.main_text(wrap('<div class="content has-sidebar"><p>a</p><div class="sidebar">b</div></div>')) == "a"
    # running text of an article
    assert pg.main_text(wrap('<article><p class="notice">a</p><section id="legal"><p>b</p></section><section class="share">c</section>'
                             '<div class="share">d</div><section id="comments">e</section><p class="ad">f</p></article>')) == "a\n\nb\n\nc"
    # regions of other articles
    assert pg.main_text(wrap('<article><p>a</p></article><div class="related"><article>b</article></div>')) == "a"
    assert pg.main_text(wrap('<main><p>a</p><section id="comments"><article>b</article></section></main>')) == "a"
    assert pg.main_text(wrap('<article><p>a</p></article><footer class="no-ads"><article>b</article></footer>')) == "a"
    assert pg.main_text(wrap('<div class="menu"><article>b</article></div><article><p>a</p></article>')) == "a"
