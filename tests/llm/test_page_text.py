import random

import numpy as np
import pytest

from swarmframe.llm.page_text import blocks_of, main_texts, ranks, shared_strings, window_key


@pytest.mark.parametrize("html, blocks", [
    (None, []), ("", []), ("plain &amp; text", [("open", "plain & text")]),
    ("<p>a<p>b<div class=ad>x<p>y</div>c", [("open", "a"), ("open", "b"), ("never", "x"), ("never", "y"), ("open", "c")]),
    ("<nav>m</nav><article><h1>T</h1><p>k&nbsp;\n q<br>z<section class='reader comments'>no</section>r</article>f",
     [("never", "m"), ("article", "T"), ("article", "k q z"), ("never", "no"), ("article", "r"), ("open", "f")]),
    ("<script>var t='</p><article>';</script><style>p{}</style><!-- <article>x</article> -->y", [("open", "y")]),
    ("<article>one<form><input value='a>b'>two</form><aside>three</aside></article", [("article", "one"), ("never", "two"), ("never", "three")]),
    ("a <3 b<br/>c </b></div> d <b", [("open", "a <3 b c"), ("open", "d")]),
    ("<ul><li>x<li>y</ul><p id=\"cookie-notice\">n</p>t&am &copy 5 &#233;", [("open", "x"), ("open", "y"), ("never", "n"), ("open", "t&am © 5 é")]),
    ("<div title='" + "x" * 50_000 + ">q", [("open", "q")]),
])
def test_blocks(html, blocks):
    assert blocks_of(html) == blocks


@pytest.mark.parametrize("length", [1, 2, 3, 6, 8, 11])
def test_ranks_are_those_of_sorted_windows(length):
    rng = np.random.default_rng(length)
    tokens = rng.integers(0, 3, 200)
    windows = [tuple((tokens[i:i + length] + 1).tolist() + [0] * (length - len(tokens[i:i + length]))) for i in range(200)]
    order = {w: k + 1 for k, w in enumerate(sorted(set(windows)))}
    assert ranks(tokens, length).tolist() == [order[w] for w in windows]


def test_shared_strings_are_all_windows():
    rng = random.Random(1)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(60)]
    want = {}
    for page, s in enumerate(streams):
        for k in range(len(s) - 3):
            want.setdefault(window_key(s[k:k + 4]), []).append(page)
    assert {k: (a, b) for k, a, b in shared_strings(list(range(60)), streams, 4)} == {k: (min(v), max(v)) for k, v in want.items()}
    assert shared_strings([], [], 4) == [] and shared_strings([1], [["a"]], 4) == []


LETTER = "<div>Subscribe to our weekly letter and get all the news</div>"
PAGES = [(1, "http://a.x/1", LETTER + "<div>one unique text here</div>"), (2, "https://A.x:80/2?q", LETTER + "<p>two other text</p>"),
         (3, "http://b.x/1", LETTER + "solo"), (4, None, None), (5, "http://a.x/5", f"<article>Art {LETTER}</article>"),
         (5, "http://a.x/5", f"<article>Art {LETTER}</article>"), (6, "http://c.y/", ""), (None, "http://d.z/", LETTER), (None, "http://d.z/", LETTER),
         (8, "http://e.z/", "<main>" + "long text " * 30_000 + "</main>")]
NEWS = "Subscribe to our weekly letter and get all the news"


@pytest.mark.parametrize("shard_pages", [1, 2000])
def test_repeated_text_goes_where_no_article_is_marked(spark, shard_pages):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, text string, host int").repartition(3)
    got = sorted((r["page_id"] or -1, r["text"]) for r in main_texts(pages, shard_pages=shard_pages).collect())
    assert got == sorted([(1, "one unique text here"), (2, "two other text"), (3, NEWS + "\nsolo"), (4, ""), (5, "Art\n" + NEWS), (5, "Art\n" + NEWS),
                          (6, ""), (-1, NEWS), (-1, NEWS), (8, ("long text " * 30_000).strip())])
    assert main_texts(pages.limit(0)).collect() == []


def texts_of_pages(spark, htmls):
    pages = spark.createDataFrame([(i, f"http://h.x/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(main_texts(pages).collect(), key=lambda r: r["page_id"])]


def body(i, n=60):
    return " ".join(f"body{i}w{k}" for k in range(n))


def test_no_page_escapes_by_a_mark_that_is_not_its_article(spark):
    marks = ["<script>var a = '<article>'</script>", "<!-- <main> -->", "<article class=comment>a reader</article>", "<article>a card of few words</article>"]
    got = texts_of_pages(spark, [f"{LETTER}<div>{body(i)}</div>{m}" for i, m in enumerate(marks)])
    assert [t.split("\n")[0] for t in got] == [body(i) for i in range(4)]
    assert got[:3] == [body(i) for i in range(3)]


@pytest.mark.parametrize("edit", ["", "edited "])
def test_copied_pages_without_marks_keep_their_text(spark, edit):
    passage = f"<p>{body('passage', 30)}</p>"
    pages = [f"{LETTER}<div>{body('copied')}</div><p>{edit * i}end of the copied text</p>" for i in range(3)]
    pages += [f"{LETTER}<div>{body(i)} {body('quote', 20)} and more</div>{passage * (i < 2)}" for i in range(9)]
    got = texts_of_pages(spark, pages)
    assert all(t.split("\n")[0] == body("copied") for t in got[:3]) and NEWS not in "\n".join(got)
    assert all(t.startswith(f"{body(i)} {body('quote', 20)} and more") for i, t in enumerate(got[3:]))
    assert [body("passage", 30) in t for t in got[3:]] == [True] * 2 + [False] * 7


@pytest.mark.parametrize("html, blocks", [
    ("<div class='site has-sidebar'><p>a</p></div>", [("open", "a")]),
    ("<main class='no-sidebar'>a<div class='sidebar'>b</div></main>", [("article", "a"), ("never", "b")]),
    ("<article class='post comments-open category-social'>a</article>", [("article", "a")]),
    ("<main class=search><h1>a</h1></main>", [("article", "a")]),
    ("<div class=widget><p>t</p><article>a<div id=comments>b<article>c</article></div></article></div>d",
     [("open", "t"), ("article", "a"), ("never", "b"), ("never", "c"), ("open", "d")]),
    ("<div role=search>a</div><div id='cookie-notice'>b</div><article class=comment>c</article>", [("never", "a"), ("never", "b"), ("never", "c")]),
])
def test_names_do_not_hide_articles(html, blocks):
    assert blocks_of(html) == blocks
