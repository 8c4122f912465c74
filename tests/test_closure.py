"""Chains followed by doubling steps against walking them."""

import random

from quire.operators import closure, dom


def test_followed(spark):
    r = random.Random(1)
    steps = {}
    for i in range(300):
        if r.random() < 0.8:
            steps[f"n{i}"] = f"n{i + 1}" if r.random() < 0.8 else f"n{r.randrange(300)}"
    steps |= {"self": "self", "a": "b", "b": "a", **{f"c{i}": f"c{i + 1}" for i in range(30)}, **{f"hot{i}": "n5" for i in range(200)}}
    rows = [*steps.items(), (None, "x"), ("lost", None), ("a", "z")]
    got = {x.source: (x.final, x.hops, x.error) for x in closure.followed(spark.createDataFrame(rows, "s string, t string"), "s", "t").collect()}
    want = {}
    for s in steps:
        at, hops = s, 0
        while at in steps and hops <= 10:
            at, hops = steps[at], hops + 1
        want[s] = (at, hops, None) if hops <= 10 else (None, None, "more than 10 steps")
    assert got == want
    assert closure.followed(spark.createDataFrame([], "s string, t string"), "s", "t").collect() == []


def test_inherited(spark):
    rows = [("base", None, 10, "serif", 1), ("text", "base", None, None, 2), ("quote", "text", 9, None, 3), ("deep", "quote", None, "mono", 4), ("gone", "nowhere", None, None, 5), ("x", "y", None, "a", 6), ("y", "x", 3, None, 7), *[(f"s{i}", f"s{i - 1}" if i else None, 7 if i == 0 else None, None, i) for i in range(30)]]
    got = {x.name: (x.size, x.font, x.n) for x in closure.inherited(spark.createDataFrame(rows, "name string, based string, size int, font string, n int"), "name", "based", ["size", "font"]).collect()}
    assert {k: got[k] for k in ("base", "text", "quote", "deep", "gone", "x", "y")} == {"base": (10, "serif", 1), "text": (10, "serif", 2), "quote": (9, "serif", 3), "deep": (9, "mono", 4), "gone": (None, None, 5), "x": (3, "a", 6), "y": (3, "a", 7)}
    assert all(got[f"s{i}"] == (7, None, i) for i in range(30))


def test_votes_of_a_tree(spark):
    prose = "words that go on and on, with a comma in them, and so on"
    page = f"<body><nav><p>{prose}</p></nav><div class='content'><p>{prose}</p><p>{prose}</p><div><p>short</p></div></div><div class='sidebar'><p><a href='/x'>{prose}</a></p><p>{prose}</p></div><h2>Head, ing</h2></body>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>no"), (1 << 40, page)], "page_id long, html string")
    every = dom.measured(dom.nodes(pages, "page_id", "html"), "page_id")
    got = {(x.page_id, x.tag, x.pre): x for x in dom.votes(every, "page_id").collect()}
    chars = len(prose.replace(" ", ""))
    weight = 1 + chars / 100 + 2
    best = {x.page_id: x for x in dom.best(dom.votes(every, "page_id"), "page_id").collect()}
    assert set(best) == {1, 1 << 40} and best[1].tag == "div" and best[1].blocks == 2 and best[1].chars == 2 * chars + 5
    assert abs(best[1].score - 2 * weight * 1.35) < 1e-9
    side = next(x for k, x in got.items() if k[0] == 1 and x.chars == 2 * chars)
    assert abs(side.score - 2 * weight * 0.5 * 0.4) < 1e-9
    assert [(x.href, x.chars) for x in dom.links(every, "page_id").filter("page_id = 1").collect()] == [("/x", chars)]
    assert [(x.rank, x.chars) for x in dom.headings(every, "page_id").filter("page_id = 1").collect()] == [(2, 8)]
