"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from quire.llm import jaccard_join as J


def grams(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=90):
    """(doc_id, n_shingles, component_id) of each row, by a search over documents."""
    sets = [(i, grams(t)) for i, t in rows]
    every = [(i, s) for i, s in sets if i is not None and s]
    near = {}
    for a, (i, x) in enumerate(every):
        for j, y in every[:a]:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                near.setdefault(i, set()).add(j)
                near.setdefault(j, set()).add(i)
    label = {}
    for i in sorted({i for i, _ in sets if i is not None}):
        todo = [] if i in label else [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo.extend(near.get(k, ()))
    return sorted((i is not None, i or 0, len(s), label.get(i)) for i, s in sets)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "n", "p") for i, t in rows], "doc_id long, text string, name string, part string").repartition(5)
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_join(docs, **more).collect())


def family(r, n, size, changes, bag):
    base = r.choices(bag, k=size)
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(r.randint(*changes)):
            w[r.randrange(len(w))] = r.choice(bag)
        out.append(" ".join(w))
    return out


def test_brute_force(spark):
    r = random.Random(1)
    bag = [f"w{i}" for i in range(3000)]
    texts = []
    for size, changes in ((40, (0, 2)), (120, (0, 4)), (200, (2, 5)), (60, (1, 3)), (300, (5, 9))):
        texts += family(r, 40, size, changes, bag)
    passage = " ".join(r.choices(bag, k=60))
    texts += [passage + " " + " ".join(r.choices(bag, k=r.choice([2, 5, 8, 40]))) for _ in range(60)]
    texts += [" ".join(r.choices(bag[:3], k=r.randint(1, 5))) for _ in range(40)] + ["A b C", "a B c", "a  b\tc", None, "", " ", texts[3].upper(), "x" * 5000, "only two", "only Two"]
    rows = [(r.randrange(10**6), t) for t in texts]
    rows += [(5, texts[0]), (5, texts[70]), (7, texts[70]), (None, texts[1]), (rows[9][0], rows[9][1]), (-3, texts[2])]
    assert run(spark, rows) == brute(rows)


def test_chains_are_followed(spark):
    r = random.Random(2)
    bag = [f"v{i}" for i in range(900)]
    w = r.choices(bag, k=150)
    rows = []
    for i in range(90):
        rows.append((i, " ".join(w)))
        w = w[:]
        w[r.randrange(150)] = r.choice(bag)
    got = run(spark, rows)
    assert got == brute(rows) and len({x[3] for x in got}) < 10


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (None, "a b c d")]) == [(False, 0, 2, None), (True, 1, 0, 1)]


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_needed_and_prefixes(percent):
    r = random.Random(percent)
    for _ in range(400):
        n = r.randint(1, 60)
        x = set(r.sample(range(80), n))
        y = set(x)
        for _ in range(r.randint(0, 8)):
            y.discard(r.choice(sorted(y))) if len(y) > 1 and r.random() < 0.5 else y.add(r.randrange(80))
        both = len(x & y)
        linked = 100 * both >= percent * (len(x) + len(y) - both)
        assert linked == (both >= J.needed(len(x), len(y), percent))
        held = np.array([r.randint(1, 9) for _ in range(80)])
        order = sorted(range(80), key=lambda t: (held[t], t))
        pre = []
        for s in (x, y):
            own = [t for t in order if t in s]
            length, reach = J.prefixes(np.array([0]), np.array([len(own)]), held[own], percent)
            pre.append((int(length[0]), own[: int(reach[0])]))
        if linked:
            least = min(pre[0][0], pre[1][0])
            both_sides = [set(o[: len(s) - J.needed(len(x), len(y), percent) + least]) for s, (_, o) in zip((x, y), pre)]
            assert len(both_sides[0] & both_sides[1]) >= least


def test_costly_prefixes_are_longer():
    held = np.array([*[900] * 12, *[2] * 88])
    held.sort()
    cheap, _ = J.prefixes(np.array([0]), np.array([100]), held, 90)
    dear, _ = J.prefixes(np.array([0]), np.array([100]), np.full(100, 500), 90)
    assert cheap[0] >= 1 and dear[0] > 1


def test_a_family_of_one_template_is_not_all_pairs(spark):
    """Each text has an eighth of its own: no pair is linked, and none is met."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(300):
        w = base[:]
        w[20:40] = [f"own{i}x{k}" for k in range(20)]
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    met = []
    across = J._across
    J._across = lambda *a: met.append(across(*a)) or met[-1]
    try:
        assert run(spark, rows) == [(True, i, 158, i) for i in range(300)]
    finally:
        J._across = across
    assert met[0].count() < 300
