"""op1, op2 and op10 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import sais
from quire.llm.near_dedup import near_duplicates, prob_minhash, probability_jaccard, shingles
from quire.llm.recompression_dedup import dedup_windows, recompress
from quire.llm.suffix_dedup import dedup_suffixes

LOW = -(1 << 63)


def covered(units, ids, size, own_too):
    """For each row the units that an earlier window covers.  own_too: also earlier in the same row."""
    ids = [LOW if i is None else i for i in ids]
    first = {}
    for u, i in zip(units, ids):
        for j in range(len(u) - size + 1):
            k = u[j : j + size]
            first[k] = min(first.get(k, i), i)
    out = []
    for u, i in zip(units, ids):
        cov, seen = [False] * len(u), set()
        for j in range(len(u) - size + 1):
            k = u[j : j + size]
            if first[k] < i or own_too and k in seen:
                cov[j : j + size] = [True] * size
            seen.add(k)
        out.append(cov)
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 4, 26])
def test_suffix_order_is_exact_up_to_depth(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 7, 90, 700):
        t = rng.integers(1, 1 + alphabet, n).astype(np.uint8)
        t[rng.random(n) < 0.03] = 0
        t = np.append(t, np.array([3, 2, 0], np.uint8))
        order, data = sais.suffix_array(t, 50), t.tobytes()
        assert sorted(order) == list(range(len(t)))
        heads = [data[i : i + 50] for i in order]
        assert heads == sorted(heads)


def test_permuted_common_prefixes():
    t = np.frombuffer(b"abcabcabcabcabcabc\0abcabcabcabc\0", np.uint8)
    order = sais.suffix_array(t, 9)
    order = order[order + 9 <= len(t)]
    same, data = sais.permuted_common(t, order, 9), t.tobytes()
    for a, b in zip(order[:-1], order[1:]):
        assert same[b] == (data[a : a + 9] == data[b : b + 9])


@pytest.mark.parametrize("length,gram,hot", [(50, 20, 1024), (50, 20, 1), (12, 8, 2)])
def test_suffix_dedup(docs, rows, length, gram, hot):
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in dedup_suffixes(docs, length=length, gram=gram, hot=hot).collect())
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), b, c in zip(rows, data, covered(data, [i for i, _ in rows], length, False)):
        spans = tuple((m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in c)))
        want[i, len(b), spans, bytes(x for x, y in zip(b, c) if not y)] += 1
    assert got == want


def test_no_shard_gets_over_twice_the_mean():
    import pyarrow as pa

    from quire.llm.blobs import shard_cuts
    from quire.llm.suffix_dedup import _Bucket
    from tests.llm.conftest import words

    table = pa.table({"doc_id": list(range(40)), "text": [words(1500, 7000 + i) for i in range(40)]})
    with np.errstate(over="ignore"):
        on, cut = shard_cuts(_Bucket(table, 50, 20).grams, 64)
    assert list(on) == list(range(64)) and np.diff(cut).max() < 2 * np.diff(cut).mean()


def test_a_short_phrase_of_a_third_of_all_documents_fills_no_shard():
    """The stages called one after the other: bytes that each shard gets, and the result against brute force."""
    import pyarrow as pa

    from quire.llm import suffix_dedup as s

    r, phrase, shards = random.Random(8), "Licensed under the Apache License, Version 2.0.", 64
    line = ["".join(r.choice("abcdefghij ") for _ in range(25)) for _ in range(12000)]
    passage = "".join(r.choice("klmnop ") for _ in range(400))  # with the same runs everywhere
    texts = []
    for i in range(20000):
        mid = phrase if i % 3 == 0 else passage if i % 50 == 1 else ""
        texts.append(r.choice(line) + r.choice(line) + mid + r.choice(line) + r.choice(line))
    texts[9000:9040] = texts[:40]  # copies
    tables = [pa.table({"bucket": [b] * len(texts[b::64]), "doc_id": list(range(b, 20000, 64)), "text": texts[b::64]}) for b in range(64)]

    def exchange(rows, key):
        every = pa.concat_tables(rows)
        return [every.filter(pa.compute.equal(every[key], k)) for k in pa.compute.unique(every[key]).to_pylist()]

    with np.errstate(over="ignore"):
        one = exchange([s._grams(t, 50, 20, shards) for t in tables], "shard")
        first = exchange([s._gram_answers(t, s.HOT) for t in one], "bucket")
        first = {t["bucket"][0].as_py(): t for t in first}
        two = exchange([s._entries(t, first[b], 50, 20, shards) for b, t in enumerate(tables)], "shard")
        second = {t["bucket"][0].as_py(): t for t in exchange([s._suffixes(t, 50) for t in two], "bucket")}
        got = [s._cover(t, pa.concat_tables([first[b], second[b]]), 50, 20, shards) for b, t in enumerate(tables)]
    sent = [sum(len(s.unpack(x.as_py(), np.uint8)) for x in t["data"]) for t in two]
    assert len(sent) == shards and max(sent) < 4 * sum(sent) / shards
    assert any(2 in t["stage"].to_pylist() for t in first.values())
    kept = {i: bytes(k) for t in got for i, k in zip(t["doc_id"].to_pylist(), t["kept"].to_pylist())}
    units = [t.encode() for t in texts]
    want = covered(units, list(range(20000)), 50, False)
    assert all(kept[i] == bytes(x for x, y in zip(u, c) if not y) for i, (u, c) in enumerate(zip(units, want)))


def test_a_passage_of_all_buckets_is_not_hot():
    import pyarrow as pa

    from quire.llm import suffix_dedup as s
    from tests.llm.conftest import words

    passage, phrase = words(80, 71), words(7, 72)[:40]
    with np.errstate(over="ignore"):
        middle = set(s._Bucket(pa.table({"doc_id": [0], "text": [passage[60:-60]]}), 50, 20).grams.tolist())
        for inner, hot in ((passage, False), (phrase, True)):
            tables = [pa.table({"bucket": [b] * 2, "doc_id": [2 * b, 2 * b + 1], "text": [words(20, 3 * b) + inner + words(20, 3 * b + 1)] * 2}) for b in range(60)]
            one = pa.concat_tables([s._grams(t, 50, 20, 1) for t in tables])
            said = s._gram_answers(one, 20).to_pylist()
            flags = {r["bucket"]: r["bits"] for r in said if r["stage"] == 2}
            inside = set(s._Bucket(pa.table({"doc_id": [0], "text": [inner + "." * 50]}), 50, 20).grams.tolist())
            found = set()
            for r in one.to_pylist():
                keys = np.frombuffer(r["keys"], np.uint64)
                if r["bucket"] in flags:
                    found |= set(keys[s.unbits(flags[r["bucket"]], len(keys))].tolist())
            assert found & inside if hot else not found & middle


def test_cuts_cost_what_the_keys_do():
    from quire.llm.blobs import U, shard_cuts

    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False))
    keys = np.concatenate([np.zeros(2, U), keys, np.full(1, (1 << 64) - 1, U)])
    for n in (1, 2, 64, 1000, 10**9, 1 << 31):
        on, cut = shard_cuts(keys, n)
        assert len(on) <= len(keys) and len(cut) == len(on) + 1 and (np.diff(cut) > 0).all() and cut[-1] == len(keys)
        step = ((1 << 64) - 1) // n
        want = [min(int(k) // step, n - 1) for k in keys]
        assert want == [int(s) for s, i, j in zip(on, cut[:-1], cut[1:]) for _ in range(j - i)]
    assert [len(x) for x in shard_cuts(keys[:0], 1 << 31)] == [0, 1]


def test_long_runs_of_one_byte_are_placed_at_once():
    for data in (b"a" * 900 + b"b" * 700 + b"a" * 400 + b"\0" * 300 + b"b", b"x" + b" " * 2000 + b"y" + b" " * 1500):
        order = sais.suffix_array(np.frombuffer(data, np.uint8), 50)
        keys = [data[i : i + 50] for i in order]
        assert sorted(order) == list(range(len(data))) and keys == sorted(keys)
    assert len(sais.suffix_array(np.zeros(2_000_000, np.uint8), 50)) == 2_000_000


@pytest.mark.parametrize("window,rounds", [(20, 3), (5, 2), (20, 0)])
def test_window_dedup(docs, rows, window, rounds):
    got = Counter((r.doc_id, r.n_words, bytes(r.kept).decode()) for r in dedup_windows(docs, window=window, rounds=rounds).collect())
    units = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    want = Counter((i, len(u), " ".join(x for x, y in zip(u, c) if not y)) for (i, _), u, c in zip(rows, units, covered(units, [i for i, _ in rows], window, True)))
    assert got == want


def test_equal_windows_share_interior_symbols():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    with np.errstate(over="ignore"):
        seen = []
        for before in (3, 11):
            row = np.concatenate([rng.integers(0, 1 << 60, before).astype(np.uint64), names, rng.integers(0, 1 << 60, 9).astype(np.uint64)])
            first = np.zeros(len(row), bool)
            first[0] = True
            symbol, low, high, at = recompress(row, first, 3)
            assert at[0] == 0 and (np.diff(at) > 0).all()  # spans follow each other and leave no word out
            inside = (low >= before) & (high <= before + 60)
            seen.append([(int(s), int(a) - before, int(b) - before) for s, a, b in zip(symbol[inside], low[inside], high[inside])])
    assert seen[0] == seen[1] and len(seen[0]) > 10


def test_windows_are_named_by_their_symbols():
    """Over random rows: names are equal where the words are, and most windows are named by symbols of several words."""
    import pyarrow as pa

    from quire.llm.recompression_dedup import _Bucket

    rng = random.Random(4)
    shared = [f"w{rng.randrange(60)}" for _ in range(300)]
    texts = [" ".join([f"x{rng.random()}" for _ in range(rng.randint(0, 9))] + shared[i : i + 90] + ["z"] * rng.randint(0, 30)) for i in (0, 40, 90, 0, 13)]
    with np.errstate(over="ignore"):
        b = _Bucket(pa.table({"doc_id": list(range(5)), "text": texts}), 20, 3)
        words = [w for t in texts for w in t.split()]
        at = np.concatenate([np.arange(s, s + c - 19) for s, c in zip(b.words.begin, b.words.count)])
        names = list(zip(b._named(at, 0xCA5A826395121157).tolist(), b._named(at, 0xA0761D6478BD642F).tolist()))
    assert len(set(names)) == len({tuple(words[i : i + 20]) for i in at}) == len({(n, tuple(words[i : i + 20])) for n, i in zip(names, at)})
    inside = [((b.low >= i) & (b.high <= i + 20)).sum() for i in at]
    assert np.mean([n > 0 for n in inside]) > 0.9 and np.mean(b.span[1] - b.span[0]) > 2


def test_probability_jaccard_is_estimated():
    rng = np.random.default_rng(1)
    name = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = np.ones(300), np.ones(300)
    a[200:], b[:100] = 1e-9, 1e-9
    with np.errstate(over="ignore"):
        both = prob_minhash(np.repeat([0, 1], 300), np.concatenate([name, name]), np.concatenate([a, b]), 2, 2048)
    assert abs((both[0] == both[1]).mean() - 1 / 3) < 0.05


def weighted(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {s: 1 + math.log(n) for s, n in Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))).items()} if w else {}


def similarity_of(x, y):
    """The probability Jaccard similarity by its definition; of sets the plain one."""
    if set(x.values()) | set(y.values()) == {1.0}:
        return len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def components(rows, size, similarity):
    sets = {n: weighted(t, size) for n, (i, t) in enumerate(rows) if i is not None}
    sets = {n: x for n, x in sets.items() if x}
    label = {n: n for n in sets}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and similarity_of(sets[a], sets[b]) >= similarity - 1e-9:
                label[top(b)] = top(a)
    out = {}
    for n in sets:
        out.setdefault(top(n), []).append(rows[n][0])
    return {i: min(ids) for ids in out.values() for i in ids}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    want = components(rows, 5, 0.8)
    assert got == {i: want.get(i, i) for i, _ in rows}
    assert near_duplicates(docs).count() == len(rows)


def test_near_copies_of_many_sizes(spark):
    from tests.llm.conftest import words

    rows = []
    for k in range(12):
        base = words(60 + 40 * k, 100 + k).split()
        for j in range(5):
            own = list(base)
            for p in range(j):
                own[7 + 11 * p] = f"edit{j}{p}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows, 5, 0.8)


def test_pairs_inside_a_template_family(spark):
    """Pages of one template come in similar pairs, and two pages of different pairs are just under 0.8."""
    from tests.llm.conftest import words

    base, rows = words(260, 900), []
    for k in range(80):
        own = words(11, 1000 + k)
        rows += [(i, f"{base} {own} {words(23, 2000 + i)}") for i in (2 * k, 2 * k + 1)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert all(0.75 < len(sets[0] & x) / len(sets[0] | x) < 0.8 for x in sets[2:])
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows, 5, 0.8) == {i: i - i % 2 for i, _ in rows}


def test_weighted_similarity_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        x, y = ({int(k): float(w) for k, w in zip(rng.choice(60, 30, replace=False), 1 + np.log(rng.integers(1, 9, 30)))} for _ in "ab")
        arrays = [a for d in (x, y) for a in (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))]
        assert abs(probability_jaccard(*arrays) - similarity_of(x, y)) < 1e-12


def test_no_link_of_many_families_is_lost(spark):
    """Over 1,000 documents in families of chained edits, some with repeated lines: the classes of all pairs."""
    from tests.llm.conftest import words

    rng, rows = random.Random(5), []
    for f in range(40):
        base = words(90, 5000 + f).split() + (words(7, 6000 + f) + " ").split() * (f % 4)
        family = [base]
        for _ in range(25):
            own = list(rng.choice(family))
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = f"e{rng.random()}"
            family.append(own)
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(family)]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: weighted(t, 5) for i, t in rows}
    want, ids, family = {i: i for i in sets}, sorted(sets), lambda i: i // 26

    def top(n):
        while want[n] != n:
            n = want[n]
        return n

    for a in ids:
        for b in ids:
            if a < b and family(a) == family(b) and top(a) != top(b) and similarity_of(sets[a], sets[b]) >= 0.8 - 1e-9:
                want[max(top(a), top(b))] = min(top(a), top(b))
    assert len(ids) > 1000 and got == {i: top(i) for i in ids}


def test_shingles_of_short_texts():
    with np.errstate(over="ignore"):
        doc, name, count = shingles([b"", b"a b", b"a b", b"b a", b"a b c d e a b c d e a"], 5)
    assert list(doc) == [1, 2, 3, 4, 4, 4, 4, 4] and name[0] == name[1] != name[2] and count.max() == 2


@pytest.mark.parametrize("operator", [dedup_suffixes, dedup_windows, near_duplicates])
def test_empty_tables(nothing, operator):
    assert operator(nothing).collect() == []
