import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from antecede.llm import html_wrappers as H

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon".split()


def prose(r, n=30):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def wrapper_of(pages):
    items = None
    for page in pages:
        own = H.expression(H.parse(page))
        items = own if items is None else H.align(items, own)
    return H.Wrapper(json.loads(json.dumps(items)))


def test_unlabelled_boilerplate_of_a_host_goes_by_its_wrapper():
    r = random.Random(1)
    pages, wanted = [], []
    for k in range(8):
        body = [prose(r) for _ in range(r.randint(1, 5))]
        menu = "".join(f'<div><a href="/{x}">{x}</a></div>' for x in ("Home", "World", "Sport", "Money", "Arts"))
        pages.append(f"<html><body><div id=top>{menu}</div><div>We are open every day, and all our prices include everything that you can think of.</div>"
                     f"<div><h1>Title {k}</h1>{''.join(f'<p>{x}</p>' for x in body)}<p>Printed on paper from our own woods.</p></div><div>All rights kept by us.</div></body></html>")
        wanted.append("\n\n".join([f"Title {k}", *body]))
    wrapper = wrapper_of(pages)
    got = [H.main_text(p, wrapper) for p in pages]
    assert got == wanted
    assert all("Home" not in x and "rights" not in x for x in got) and all("open every day" in H.main_text(p, H.Wrapper([["e", "html", []]])) for p in pages)


def test_names_only_settle_what_the_slots_leave_open():
    r = random.Random(2)
    page = lambda k: (
        f'<body><nav><a href="/">Home</a></nav><article><h1>T{k}</h1><p>{prose(r)}</p><section class="related work"><p>{prose(r)}</p></section><div id="share"><p>{prose(r)}</p></div>'
        f'<div class="alert">{prose(r)}</div><div class="related"><ul><li><a href="/a{k}">see {k}</a></li><li><a href="/b{k}">more {k}</a></li></ul></div><div class="share">Share this</div>'
        f'<section class="comments"><p>{prose(r)}</p></section></article></body>'
    )
    pages = [page(k) for k in range(6)]
    wrapper = wrapper_of(pages)
    for p in pages:
        blocks = H.main_text(p, wrapper).split("\n\n")
        assert len(blocks) == 5 and "see" not in "".join(blocks) and "Share this" not in blocks
        assert "".join(blocks[1:]) == "".join(re.findall("(?:<p>|alert\">)([a-z. ]*)<", p.split('<section class="comments">')[0]))


def test_a_host_of_copies_keeps_its_text():
    page = f"<body><div><a href=/>menu</a></div><article><h1>One</h1><p>{prose(random.Random(3))}</p></article></body>"
    assert H.main_text(page, wrapper_of([page] * 9)).startswith("One\n\n") and H.main_text(page, wrapper_of([page])) == H.main_text(page, None)


def _as_text(element):
    return "".join("#" if isinstance(x, H.Text) else f"<{x[0]}>{_as_text(x)}</>" for x in element[1] if (x.words() if isinstance(x, H.Text) else x[0] not in H._RAW))


def _as_pattern(items):
    mark = {"?": "(?:%s)?", "+": "(?:%s)+"}
    return "".join("#" if x[0] == "t" else f"<{x[1]}>{_as_pattern(x[2])}</>" if x[0] == "e" else mark[x[0]] % _as_pattern(x[1]) for x in items)


@pytest.mark.parametrize("seed", range(12))
def test_a_wrapper_matches_each_page_that_it_was_made_of(seed):
    """The regular expression that a wrapper stands for, by brute force of the regex engine."""
    r = random.Random(seed)

    def tree(depth):
        return "".join(r.choice(["text", f"<div>{tree(depth - 1)}</div>", f"<p>{tree(0)}</p>", f"<section>{tree(depth - 1)}</section>"]) if depth else r.choice(["words", "", "more"]) for _ in range(r.randint(0, 3)))

    pages = [f"<body>{tree(3)}</body>" for _ in range(5)]
    items = None
    for page in pages:
        own = H.expression(H.parse(page))
        items = own if items is None else H.align(items, own)
    for page in pages:
        assert re.fullmatch(_as_pattern(items), _as_text(H.parse(page))), page


def test_alignment_of_long_unlike_lists_takes_no_square():
    r = random.Random(4)
    long_ = lambda: "".join(f"<{r.choice(['p', 'h2', 'div', 'ul', 'table'])}>x" for _ in range(40_000))
    began = time.process_time()
    wrapper = wrapper_of([f"<body>{long_()}</body>" for _ in range(2)])
    assert time.process_time() - began < 60 and len(json.dumps(wrapper.items)) < 1_000_000


def test_pairs_are_in_order_and_equal_on_either_way(monkeypatch):
    r = random.Random(5)
    for most in (0, 10**9):
        monkeypatch.setattr(H, "MOST_PAIRS", most)
        for _ in range(200):
            a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
            found = H._pairs(a, b)
            assert all(a[i] == b[j] for i, j in found) and found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_odd_pages(spark):
    """Nulls, empty and repeated pages, extra columns with clashing names, an empty table, both ways of sending wrappers."""
    long_ = "word " * 200_000
    rows = [(1, "http://a.b/1", None), (2, None, ""), (3, None, "<p>x"), (3, None, "<p>x"), (None, "http://a.b/2", "<article><p>A &amp; B</article>"), (4, "no address", "plain"), (5, "http://a.b/3", f"<article><p>{long_}</article>"), (6, "http://a.b/4", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "host": F.lit(2), "_host": F.lit(3), "wrapper": F.lit("w")})
    want = sorted([(1, ""), (2, ""), (3, "x"), (3, "x"), (-1, "A & B"), (4, "plain"), (5, long_.strip()), (6, "deep")])
    for chars in (10**6, 0):
        got = H.extract(pages.withColumnRenamed("_host", "_h"), broadcast_chars=chars)
        assert sorted((-1 if x.page_id is None else x.page_id, x.text) for x in got.collect()) == want and "wrapper" in got.columns
        assert all(x.n_chars == len(x.text) for x in got.collect())
    assert H.extract(pages.where("page_id > 99").drop("_host")).count() == 0
