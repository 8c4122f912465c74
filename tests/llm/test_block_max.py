"""Ranked search against scoring of every document."""

import math
import random
import re
from collections import Counter

from quire.llm import block_max as B

TERM = re.compile(B.TERM)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    every = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    big, long = len(every), sum(n for _, _, n in every)
    df = Counter(t for _, c, _ in every for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for doc, count, n in every:
            m = 100 - 75 + 75 * n * big // long
            score = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (1000000000 * count[t] // (1000 * count[t] + 8 * m)) for t in terms(text) if count[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, nobody, doc) in enumerate(sorted(found)[:top], 1):
            out[item, rank, None if nobody else doc, -score] += 1
    return out


def corpus(seed, n=300):
    r = random.Random(seed)
    bag = [f"{a}{b}" for a in ("Ab", "cé", "ZZ", "x9", "łą", "q") for b in range(25)]
    weights = [1 / (k + 1) for k in range(len(bag))]
    rows = [(i, r.choice(["", " ", "-"]) + " ".join(r.choices(bag, weights, k=r.choice([1, 3, 30, 200])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "...,;"), (5, rows[5][1]), (None, rows[7][1]), (n + 3, " ".join(r.choices(bag, k=30000))), *[(n + 4 + i, rows[9][1]) for i in range(20)]]
    items = [(i, " ".join(r.choices(bag, weights, k=r.choice([1, 2, 12])))) for i in range(25)] + [(100, None), (101, "?"), (102, "unknown words"), (None, "Ab0 ab0"), (3, "x91 x91 Q1")]
    return rows, items


def ask(spark, rows, items, size=8, **more):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, terms string, rank string").repartition(3)
    asked = spark.createDataFrame([(i, t, "a", "b") for i, t in items], "item_id long, text string, doc_id string, lot string")
    return B.search(B.build(docs, size=size), asked, **more)


def test_brute_force(spark):
    rows, items = corpus(1)
    assert Counter(map(tuple, ask(spark, rows, items).collect())) == brute(rows, items, 10)


def test_lots_and_other_sizes(spark):
    rows, items = corpus(2, 120)
    assert Counter(map(tuple, ask(spark, rows, items, size=1, top=3, pass_bytes=200).collect())) == brute(rows, items, 3)


def test_blocks_are_left_out(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices("abcdefgh", k=40)) + (" rare word" if 400 <= i < 412 else "")) for i in range(2000)]
    items = [(1, "rare word"), (2, "rare a")]
    out = ask(spark, rows, items, visited=True).agg({"blocks": "sum", "scored": "sum"}).first()
    assert out["sum(scored)"] < out["sum(blocks)"] / 10
    assert Counter(map(tuple, ask(spark, rows, items).collect())) == brute(rows, items, 10)


def test_empty(spark):
    rows, items = corpus(4, 20)
    assert ask(spark, [], items).collect() == [] and ask(spark, rows, []).collect() == [] and ask(spark, [(1, None)], items).collect() == []


def test_native_count_of_terms(spark):
    rows, _ = corpus(5, 40)
    rows.append((900, "a\x00b\x7fc\x80d \U0001f600e_f é"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, documents, total = B.build(docs)
    assert total == sum(len(terms(t)) for _, t in rows) and documents == sum(bool(terms(t)) for _, t in rows)
