import html
import math
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliate.llm import html_main
from foliate.llm.html_main import Page, importance, main_text, parsed


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, row int")


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in main_text(rows(spark, pages)).collect()}


def test_marked_articles(spark):
    u = "http://a.example/x"
    pages = [
        (u, "<body><nav>Menu</nav><div class='ad'>Buy<article><h1>T &amp; t</h1><p>a\n <b>b</b><br>c<p>d<script>x('</p>')</script><div id=comments>no</div><footer>f</footer></article><footer>z</footer>"),
        (u, "<main><p>one</p><aside>side</aside><ul><li>x<li>y</ul><form><p>mail</p></form></main><p>outside"),
        (u, None),
        (None, "<p>only"),
        (u, "<!-- <p>no --> &lt;plain&gt;&nbsp; text </b></p>"),
        (u, "<header>Site</header><table><tr><td>a<td>b<tr><td>c</table><style>p{}</style>"),
        (u, ""),
    ]
    got = texts(spark, pages)
    assert got == {0: "T & t\na b c\nd", 1: "one\nx\ny", 2: "", 3: "only", 4: "<plain> text", 5: "a b\nc", 6: ""}
    assert main_text(rows(spark, pages).limit(0)).count() == 0


def test_repeated_branches_of_a_site_go(spark):
    page = "<body><div class=top><p>Welcome to the site</p></div><div class=body><p>story %d</p><p>more %d</p></div></body>"
    pages = [(f"http://h.example/{i}", page % (i, i * i)) for i in range(12)] + [("http://other.example/", page % (1, 1))]
    got = texts(spark, pages)
    assert all(got[i] == f"story {i}\nmore {i * i}" for i in range(12))
    assert got[12] == "Welcome to the site\nstory 1\nmore 1"  # too few pages to tell
    scores = {r["place"]: r for r in importance(parsed(rows(spark, pages))).collect()}
    assert all(0 <= r["importance"] <= 1 + 1e-9 for r in scores.values()) and any(r["pages"] == 12 and r["importance"] == 0 for r in scores.values())


def test_articles_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])
        body = body[1] if body else ""
        body = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", body)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|table|tr)\b[^>]*>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x), r["page_id"]


def test_main_part_is_chosen_by_its_text(spark):
    u = "http://a.example/x"
    pages = [
        (u, "<main><h1>Title</h1><p>story</p><article class=card>card</article></main>"),
        (u, "<main><h1>Head</h1><p class=lead>lead</p><article><p>body</p></article></main><div>rest</div>"),
        (u, "<div><h1>Title</h1><p>a story in plain divs</p></div><div><article>card 1</article><article>card 2</article></div>"),
        (u, "<article><p>first long post</p></article><article><p>second post</p></article><div>rest</div>"),
        (u, "<main><h1>T</h1></main><div><p>the whole story is here</p></div>"),
        (u, "<main><nav>menu</nav></main><article>post</article>"),
    ]
    assert texts(spark, pages) == {
        0: "Title\nstory\ncard", 1: "Head\nlead\nbody", 2: "Title\na story in plain divs\ncard 1\ncard 2",
        3: "first long post\nsecond post", 4: "T\nthe whole story is here", 5: "post",
    }


def test_copies_count_once_and_no_text_is_lost(spark):
    plain = "<body><div><p>%s</p><p>end of %s</p></div></body>"
    listed = "<article><p>%s and more words of it</p><ul><li>item %s</li></ul></article>"
    near = "<article><p>%s, long and the same on all pages</p><ul><li>%d</li></ul></article>"
    pages = [("http://same.example/", plain % ("row", "row"))] * 9
    pages += [("http://most.example/", plain % ("copy", "copy"))] * 85 + [("http://most.example/u", plain % (f"own {i}", i)) for i in range(15)]
    pages += [("http://list.example/", listed % ("copy", "x"))] * 85 + [("http://list.example/u", listed % (f"own {i}", i)) for i in range(15)]
    pages += [("http://near.example/", near % ("text", i)) for i in range(40)]
    # distinct pages with one text, and some with their own in the same place
    pages += [("http://part.example/", f"<div class=t><p>Banner</p></div><div class=n>{i}</div>") for i in range(95)] + [("http://part.example/o", f"<div class=t><p>Own {i}</p></div><div class=n>o{i}</div>") for i in range(3)]
    got = texts(spark, pages)
    want = [["row", "end of row"]] * 9 + [["copy", "end of copy"]] * 85 + [[f"own {i}", f"end of {i}"] for i in range(15)]
    want += [["copy and more words of it", "item x"]] * 85 + [[f"own {i} and more words of it", f"item {i}"] for i in range(15)]
    want += [["text, long and the same on all pages", str(i)] for i in range(40)]
    want += [[str(i)] for i in range(95)] + [[f"Own {i}", f"o{i}"] for i in range(3)]
    assert [got[i].split("\n") for i in range(len(pages))] == want


def test_names_of_topics_are_kept(spark):
    u = "http://a.example/x"
    body = "<h2 id='social-history'>History</h2><p id=search>find</p><section id='legal-framework'><p>law</p></section><h3 id='related-work'>Work</h3>"
    inside = body + "<section id=legal>rules</section><div class='search-results-table'>rows</div><div class='x share'>no</div><div id=comments>no</div>"
    shared = "<article><p>a longer story %d</p><div class='share-buttons'>Share this</div></article>"
    pages = [(u, f"<article>{inside}</article>"), (u, f"<main>{inside}</main>"), (u, f"<div>{body}<div class='share-buttons'>no</div><section id=comments>no</section></div>")]
    pages += [("http://b.example/", shared % i) for i in range(9)]
    got = texts(spark, pages)
    kept = "History\nfind\nlaw\nWork"
    assert got[0] == got[1] == kept + "\nrules\nrows" and got[2] == kept
    assert [got[i + 3] for i in range(9)] == [f"a longer story {i}" for i in range(9)]  # the tree confirms the name


def test_importance_against_brute_force(spark):
    """Entropies spelled out over the pages' own statistics."""
    pages = [("http://h.example/", f"<body><div class=m><p>Home</p><p>{'About' if i % 3 else 'Jobs'}</p></div><div class=n><p>story {i}</p>{'<p>more</p>' * (i % 2)}</div></body>") for i in range(11)]
    table = [r["stats"] for r in parsed(rows(spark, pages)).collect()]
    want = {}
    for place in {s["place"] for stats in table for s in stats}:
        own = [[s for s in stats if s["place"] == place] for stats in table]
        own = [o for o in own if o]
        m, styles, contents = len(own), {}, {}
        for o in own:
            for s in o:
                (styles if s["kind"] == 0 else contents).setdefault(s["v"], []).append(1)
        entropy = sum(-len(x) / m * math.log(len(x) / m) for x in styles.values()) / math.log(m)
        parts = [(len(x), 0.1 * entropy + 0.9 * (1 - math.log(len(x)) / math.log(m))) for x in contents.values()]
        want[place] = sum(c * x for c, x in parts) / sum(c for c, _ in parts)
    got = {r["place"]: r["importance"] for r in importance(parsed(rows(spark, pages))).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("rows_at_most", [200_000, -1])
def test_a_menu_goes_with_its_own_item(spark, monkeypatch, rows_at_most):
    monkeypatch.setattr(html_main, "BROADCAST_ROWS", rows_at_most)  # also the shuffled way
    menu = "".join(f"<li>section number {i}</li>" for i in range(30))
    pages = [("http://h.example/", f"<body><ul class=top>{menu}<li>here: {i}</li></ul><div><p>the story of page {i}</p><p>and its end {i}</p></div></body>") for i in range(10)]
    assert all(t == f"the story of page {i}\nand its end {i}" for i, t in texts(spark, pages).items())


def test_the_tree_s_part_on_the_given_table(spark):
    """Menus, adverts and footers of the given pages differ on each page: nothing repeats, and the tags decide (README)."""
    pages = parsed(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert html_main.low_features(pages).count() == 0


def test_the_tree_alone_finds_the_articles_of_the_given_table(spark):
    """All elements whose names say something are divs of a class that says nothing; only hosts of few pages need names."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    low = {r["v"] for r in html_main.low_shapes(parsed(pages)).collect()}
    template = [html_main.beside_main(r["nodes"], r["levels"], low) for r in parsed(pages).collect()]
    assert sum(len(t) == 3 for t in template) > 0.95 * len(template)  # menu, advert and footer
    want = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for i, name in enumerate(("nav", "article", "footer")):
        pages = pages.withColumn("html", F.regexp_replace("html", f"<{name}>", f"<div class=x{i}>")).withColumn("html", F.replace("html", F.lit(f"</{name}>"), F.lit("</div>")))
    pages = pages.withColumn("html", F.replace("html", F.lit(' class="ad"'), F.lit(" class=x4")))
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    same = {i for i in want if got[i] == want[i]}
    assert len(same) > 0.95 * len(want)
    large = pages.select("page_id", F.split("url", "/")[2].alias("host"), F.count("*").over(Window.partitionBy(F.split("url", "/")[2])).alias("n"))
    assert all(want[r["page_id"]] in got[r["page_id"]] for r in large.collect())  # no text of an article is lost


def test_a_template_s_parts_go_by_their_shape(spark):
    """Other words on each page, no telling name: menus, teasers and footers keep their shape, stories do not."""
    import random

    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    pages, want = [], []
    for i in range(60):
        story = [words(rng.choice([40, 90, 300])) for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{x}</p>" if k % 3 != i % 3 else f"<blockquote>{x}</blockquote>" for k, x in enumerate(story))
        menu = "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(6))
        pages.append(("http://h.example/", f"<body><div class=x1><ul>{menu}</ul></div><div class=x2>{words(8)}</div><div class=x3>{body}</div><div class=x4><p>{words(9)}</p></div></body>"))
        want.append("\n".join(story))
    got = texts(spark, pages)
    assert [got[i] for i in range(60)] == want
    few = texts(spark, pages[:5])  # too few pages to tell
    assert all(want[i] in few[i] and few[i] != want[i] for i in range(5))


def test_left_over_by_brute_force():
    """Every branch spelled out: template parts, then branches of repeated text from the top down."""
    import random

    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 9)
        nodes = [{"parent": -1, "place": 100}] + [{"parent": rng.randrange(i), "place": 100 + rng.randrange(6)} for i in range(1, n)]
        blocks = [{"node": rng.randrange(n), "text": rng.choice("abcdef") * rng.randrange(1, 9)} for _ in range(rng.randrange(0, 9))]
        low = {html_main.feature(nodes[b["node"]]["place"], b["text"]) for b in blocks if rng.random() < 0.5} | {p for p in range(100, 106) if rng.random() < 0.3}
        levels = [{"main": 1, "beside": list(range(2, n))}] if n > 1 else []
        marked = rng.random() < 0.5

        def above(i):
            return [i, *above(nodes[i]["parent"])] if i >= 0 else []

        template = {i for lv in levels if nodes[lv["main"]]["place"] not in low for i in lv["beside"] if nodes[i]["place"] in low}
        left = [b for b in blocks if not template & set(above(b["node"]))]
        total = lambda i, of: sum(len(b["text"]) for b in of if i in above(b["node"]))
        repeated = [b for b in left if html_main.feature(nodes[b["node"]]["place"], b["text"]) in low]
        gone = {i for i in range(1, n) if 0 < (1 - html_main.LEAST) * total(i, left) <= total(i, repeated)}
        kept = [b for b in left if not gone & set(above(b["node"]))]
        if not low or not kept or (marked and 2 * sum(len(b["text"]) for b in kept) < total(0, left)):
            kept = left
        assert html_main.left_over(blocks, nodes, low, marked, levels) == "\n".join(b["text"] for b in kept)


def test_hostile_pages_take_time_in_proportion():
    def seconds(source):
        start = time.process_time()
        Page("h", source).result()
        return time.process_time() - start

    for make in (lambda n: "<div>x" * n, lambda n: '<a href="x>y' * n, lambda n: "<p '" * n, lambda n: "<div>" * n + "</p></li>" * n, lambda n: "<!x" * n, lambda n: "<b><article>" * n, lambda n: "<script>" * n, lambda n: "<i><div>" + "<span>" * n + "</i>" * n, lambda n: "<p><button>" + "<span>" * n + "<pre></pre>" * n):
        seconds(make(2_000))
        small, large = seconds(make(5_000)), seconds(make(40_000))
        assert large < 24 * small + 0.5, make(2)
    assert [t for _, _, t in Page("h", '<p title="a > b">x</p><p class="y>z</p>').blocks] == ["x", "z"]


def test_a_very_long_page_is_kept_whole(spark):
    parts = [f"paragraph {i} of it" for i in range(8_000)]
    page = "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"
    assert texts(spark, [("http://a.example/", page)])[0] == "\n".join(parts)
