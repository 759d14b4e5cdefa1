"""Template deduction of pages: boxes within articles, misleading names, copies, odd rows."""

import random

import pytest

from claimworks.llm import html_extract


def story(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n))


def extracted(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {x["page_id"]: x["text"] for x in html_extract.extract(pages, **more).collect()}


@pytest.mark.parametrize("most_hosts", [20_000, 0])
def test_boxes_in_articles_go(spark, most_hosts):
    r = random.Random(1)
    body = {i: [story(r, 30) for _ in range(3)] for i in range(12)}
    page = lambda i: f"<body><div class=top>Home</div><article><p>{body[i][0]}</p><div class=qx>Join the club today</div><p>{body[i][1]}</p><div class=qy>More from this desk</div><p>{body[i][2]}</p></article></body>"
    rows = [(i, f"http://boxes.example/{i}", page(i)) for i in body]
    assert extracted(spark, rows, most_hosts=most_hosts) == {i: " ".join(b) for i, b in body.items()}
    # Without a template the boxes stay, so it is the template that drops them.
    without = extracted(spark, rows, support=10**9, most_hosts=most_hosts)
    assert all("Join the club today" in t for t in without.values())


def test_a_passage_that_few_articles_quote_stays(spark):
    r = random.Random(2)
    quote = story(r, 60)
    body = {i: f"{story(r, 90)}" for i in range(3)}
    rows = [(i, "http://few.example/", f"<body><article><p>{b}</p><p>{quote}</p></article></body>") for i, b in body.items()]
    assert extracted(spark, rows) == {i: f"{b} {quote}" for i, b in body.items()}


@pytest.mark.parametrize("before,after", [("<div class='comment-free'>", "</div>"), ("<main><div class='social-history'>", "</div></main>"), ("<div id=related-study>", "</div>")])
def test_a_name_that_hides_the_story_is_void(spark, before, after):
    r = random.Random(3)
    body = {i: [story(r, 40), story(r, 40)] for i in range(6)}
    rows = [(i, "http://names.example/", f"<body><nav>Home News {i}</nav>{before}<p>{a}</p><div class='share'>Share this {i}</div><p>{b}</p>{after}<footer>Imprint</footer></body>") for i, (a, b) in body.items()]
    assert extracted(spark, rows) == {i: f"{a} {b}" for i, (a, b) in body.items()}


def test_menus_and_comments_stay_hidden(spark):
    r = random.Random(4)
    body = {i: story(r, 30) for i in range(6)}
    page = lambda i: f"<body><nav>{story(r, 80)}</nav><article><p>{body[i]}</p></article><div class=sidebar>{story(r, 40)}</div><section class=comments><p>{story(r, 100)}</p></section></body>"
    assert extracted(spark, [(i, "http://menus.example/", page(i)) for i in body]) == body
    empty = [(i, "http://void.example/", f"<body><nav>{story(r, 20)}</nav></body>") for i in range(4)]
    assert set(extracted(spark, empty).values()) == {""}  # a tag's mark is never void


def test_teasers_do_not_replace_the_story(spark):
    r = random.Random(5)
    body = {i: story(r, 120) for i in range(6)}
    rows = [(i, "http://cards.example/", f"<body><div class=w><div class=s><p>{b}</p></div></div><div class=z><article>{story(r, 5)}</article><article>{story(r, 5)}</article></div></body>") for i, b in body.items()]
    assert extracted(spark, rows) == body


def test_clashing_names_repeats_and_nearly_equal_articles(spark):
    r = random.Random(6)
    shared = [story(r, 40) for _ in range(4)]
    rows = [(i, "http://near.example/", f"<body><article><h1>{i}</h1><p>{'</p><p>'.join(shared)}</p></article></body>", "x", "y", 1) for i in range(6)]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string, host string, text string, main int")
    got = html_extract.extract(pages).collect()
    assert len(got) == 12 and all(x["text"] == f"{x['page_id']} {' '.join(shared)}" and x["n_chars"] == len(x["text"]) for x in got)
