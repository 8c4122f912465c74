"""The queries as they are registered, on small tables with nulls, ties, repeats and clashing columns: their digest columns against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm import matroska, pii, queries
from tests.llm import test_block_max, test_jaccard_join, test_rolling_users
from tests.llm.test_dedup import components, covered
from tests.llm.test_text_ops import plain_spans, tokenizer

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("bucket", pa.string()), ("label", pa.string()), ("w", pa.string())])
PII = ["write to a.b@c9.example.org or call +1 (212) 555-0147", "token = \"0123456789abcdef0123456789abcdef01234567\" from 10.0.0.1", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "token = abcd1234abcd1234abcd1234abcd1234 my name is Ann Lee, call 212-555-0147 or phone: 212-555-0199 or +1 (212) 555-0147, card 4465758382889437"]


CLICKS = pa.schema([("click_id", pa.int64()), ("ts", pa.timestamp("us")), ("arrived_at", pa.timestamp("us")), ("client_id", pa.int64()), ("kind", pa.string()), ("value", pa.float64()), ("props", pa.string()), ("minute", pa.string()), ("chunk", pa.string())])
CLICK_ROWS = [(i % 45, None if i % 11 == 0 else i * 7_000_000_000, None, None if i % 5 == 0 else i % 4, None if i % 13 == 0 else "view" if i % 3 else "buy", 1.0, "{}", "m", "c") for i in range(60)]


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    """documents, pages and benchmark of one small table, and of an empty one."""
    out = tmp_path_factory.mktemp("registered")
    every = [*rows, *[(30 + i, t) for i, t in enumerate(PII)], (None, None), (31, PII[1])]
    some = [(i, t, "en" if i is None or i % 2 else "de", "s", len(t or ""), "b", "l", "x") for i, t in every]
    pages = [(1, "https://a.example/", "<nav>menu</nav><article><h1>T</h1><p>" + "prose, and more of it. " * 9 + "</p></article>"), (2, None, None), (None, "u", ""), (2, None, "<p>x &amp; y")]
    for name, keep in (("some", slice(None)), ("none", slice(0))):
        (out / name).mkdir()
        pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in some[keep]], SCHEMA), out / name / "documents.parquet")
        pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages[keep]], pa.int64()), "url": pa.array([p[1] for p in pages[keep]], pa.string()), "html": pa.array([p[2] for p in pages[keep]], pa.string())}), out / name / "pages.parquet")
        pq.write_table(pa.table({"item_id": pa.array([1, 2][keep], pa.int64()), "text": pa.array(["Which river flows through the old town of Paris", None][keep], pa.string())}), out / name / "benchmark.parquet")
        clicks = [dict(zip(CLICKS.names, c)) for c in CLICK_ROWS[keep]]
        pq.write_table(pa.Table.from_pylist(clicks, CLICKS), out / name / "clicks.parquet")
    return out, every, pages


def run(spark, folder, name, which="some"):
    return queries.queries()[name](spark, str(folder[0] / which)).collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_empty_tables(spark, folder, name):
    assert run(spark, folder, name, "none") == []


def test_op1(spark, folder):
    _, every, _ = folder
    data = [(t or "").encode() for _, t in every]
    want = Counter()
    for (i, _), b, c in zip(every, data, covered(data, [i for i, _ in every], 50, False)):
        want[i, len(b), sum(c), len(re.findall("1+", "".join("01"[x] for x in c))), sha(bytes(x for x, y in zip(b, c) if not y))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, folder, "op1_suffix_dedup")) == want


def test_op2(spark, folder):
    _, every, _ = folder
    units = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in every]
    want = Counter((i, len(u), sum(c), sha(" ".join(x for x, y in zip(u, c) if not y).encode())) for (i, _), u, c in zip(every, units, covered(units, [i for i, _ in every], 20, True)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, folder, "op2_recompression_dedup")) == want


def test_op3(spark, folder):
    _, every, _ = folder
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in run(spark, folder, "op3_pii_crf"))
    want = Counter()
    for i, t in every:
        base = plain_spans(t or "")
        n = Counter(k for k, _, _ in base)
        want[i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode())] += 1
    assert got == want
    for r in run(spark, folder, "op3_pii_crf"):
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        order = list(dict.fromkeys([*pii.KINDS, *pii.ADDED]))
        assert spans == sorted(spans, key=lambda x: (order.index(x[0]), int(x[1]))) and len(set(map(tuple, spans))) == len(spans) == r.n_spans
        n = Counter(k for k, _, _ in spans)
        assert (n["email"], n["ip"], n["card"]) == (r.n_email, r.n_ip, r.n_card) and n["phone"] >= r.n_phone and set(n) <= set(order)
    secret = [r for r in run(spark, folder, "op3_pii_crf") if r.doc_id == 31]
    assert len(secret) == 2 and all("secret:9:49" in r.spans for r in secret)


def test_op4(spark, folder):
    _, every, _ = folder
    got = run(spark, folder, "op4_language_id")
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in every)
    by = Counter((r.doc_id, r.lang_pred == "und") for r in got)
    assert by == Counter((i, not any(c.isalpha() for c in t or "")) for i, t in every) and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)


def test_op6(spark, folder):
    _, every, _ = folder
    want = Counter()
    for i, t in every:
        raw = (t or "").encode()
        x = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = matroska.encode(x)
        want[i, len(raw), len(x), sha(x), zlib.crc32(x[-64:]), len(media), sha(media)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in run(spark, folder, "op6_matroska")) == want


def test_op7(spark, folder):
    _, every, _ = folder
    tool, got, filled = tokenizer(), Counter(), {}
    for r in run(spark, folder, "op7_curve_packing"):
        got[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for i, t in every:
        want[i] += len(tool.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want
    for parts in filled.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 4096


def test_op8(spark, folder):
    _, _, pages = folder
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in run(spark, folder, "op8_html_density"))
    texts = ["T\n\n" + ("prose, and more of it. " * 9).strip(), "", "", "x & y"]
    assert got == Counter((p, u, x, len(x)) for (p, u, _), x in zip(pages, texts, strict=True))


def test_op10(spark, folder):
    _, every, _ = folder
    want = components(every, 5, 0.8)
    assert Counter((r.doc_id, r.class_id) for r in run(spark, folder, "op10_minhash_near_dedup")) == Counter((i, want.get(i, i)) for i, _ in every)


def test_op11(spark, folder):
    _, every, _ = folder
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in run(spark, folder, "op11_jaccard_join"))
    assert got == test_jaccard_join.brute(every)


def test_op12(spark, folder):
    rows = [(c, None if t is None else t // 60_000_000, k, u) for c, t, _, u, k, *_ in CLICK_ROWS]
    assert Counter(map(tuple, run(spark, folder, "op12_rolling_users"))) == Counter(test_rolling_users.brute(rows, (5, 30, 10080), 3, 10080))


def test_op13(spark, folder):
    _, every, _ = folder
    items = [(1, "Which river flows through the old town of Paris"), (2, None)]
    assert Counter(map(tuple, run(spark, folder, "op13_block_max_search"))) == test_block_max.brute(every, items, 10)
