"""op5 and op9: against SQL on a sample, brute force on fixtures, and native plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, licenses, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_template_decontamination", "op9_license_scan"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    assert got[columns].astype(str).sort_values(columns).values.tolist() == want[columns].astype(str).sort_values(columns).values.tolist()


@pytest.mark.parametrize("name", ["op5_template_decontamination", "op9_license_scan"])
def test_plans_have_no_python(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


QUESTION = "A train leaves the station of Lund at 12 km per hour and after 30 minutes the driver Ana meets Bo who walks 12 km the other way"


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}


def test_reparameterised_questions_are_found(spark):
    other = QUESTION.replace("12", "45").replace("30", "7").replace("Lund", "Oslo").replace("Ana", "Eva")
    broken = "x " + QUESTION.replace("12 km per", "45 km per", 1)  # one value of the item stands for two
    got = leaks(spark, ["before it. " + QUESTION + ". after", "Some text and " + other + " end", broken, "a clean text about trains and stations of all kinds", None, "", QUESTION[:40]], [QUESTION])
    assert got == {(0, 0), (1, 0)}


def test_each_occurrence_counts_by_itself(spark):
    other = QUESTION.replace("12", "45").replace("30", "7").replace("Lund", "Oslo")
    broken = QUESTION.replace("12 km per", "45 km per", 1)
    chance = "the old man at 99 km per hour and then nothing at all"
    inserted = QUESTION.replace("the driver", "then the driver")
    texts = [QUESTION + ". " + other, QUESTION + ". " + chance, other + ". " + chance + ". " + inserted, broken + ". " + chance, broken + ". " + broken.replace("45", "46")]
    assert leaks(spark, texts, [QUESTION, other]) == {(d, i) for d in (0, 1, 2) for i in (0, 1)}


def test_items_of_five_to_seven_words_are_found_whole(spark):
    items = ["Which river flows through Paris", "what is the boiling point of water", "why is the sky blue"]
    texts = ["He asked: " + items[0] + "? Nobody knew.", "so what is the boiling point of water today", "what is the boiling point of iron", "and why is the sky blue"]
    assert leaks(spark, texts, items) == {(0, 0), (1, 1), (3, 2)}


def test_short_null_and_repeated_items(spark):
    got = leaks(spark, [QUESTION, QUESTION, "one two three four"], [None, "", "one two three four", QUESTION, QUESTION])
    assert got == {(d, i) for d in (0, 1) for i in (3, 4)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, QUESTION)], "doc_id long, text string")
    assert decontaminate.leaks(none, items).collect() == [] and decontaminate.leaks(some, items).collect() == []
    assert licenses.scan(none).collect() == [] and licenses.scan(some, {}).collect() == []


FRAMES = ["A train leaves the station of Lund at 12 km per hour and after 30 minutes Ana meets Bo", "The sum of 3 and 5 is 8 and the sum of 8 and 5 is 13 so what is next", "2 4 8 16 32 64 128", "which of these rivers of the north flows through the old town of Lund"]


def test_sql_agrees_on_versions_frames_and_repeated_ids(spark, tmp_path):
    """Verbatim, changed, broken, mixed and scattered copies, under repeated and null ids."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, texts = random.Random(3), [None, "", "too few words here"]
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(FRAMES)
            for old in rng.sample(["12", "30", "3", "5", "8", "Lund", "Ana", "64"], rng.randint(0, 3)):
                t = t.replace(old, rng.choice(["7", "45", "Oslo", old]), rng.choice([1, -1]))
            w = t.split()
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w)), rng.choice(["then", "5", "and then it was so"]))
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = w[i:] if rng.random() < 0.5 else w[:i]
            parts.append(" ".join(w))
        texts.append(rng.choice([". ", " and ", " plain words between these parts "]).join(parts))
    ids = [rng.choice([None, *range(60)]) for _ in texts]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(FRAMES)), pa.int64()), "text": FRAMES}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted((tuple(r) for r in con.execute(decontaminate.OP5_SQL).fetchall()), key=key)
    got = sorted((tuple(r[c] for c in ("doc_id", "item_id", "n_words", "n_covered", "n_slots")) for r in decontaminate.op5_template_decontamination(spark, str(tmp_path)).collect()), key=key)
    assert got == want and len(got) > 40 and any(r[0] is None for r in got)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    docs = spark.createDataFrame([(None, QUESTION, "a"), (None, "clean text", "b"), (1, "clean text", "c"), (1, QUESTION, "d"), (1, QUESTION, "e"), (None, None, "f")], "doc_id long, text string, held_hash string")
    bench = spark.createDataFrame([(0, QUESTION)], "item_id long, text string")
    assert sorted(r.held_hash for r in decontaminate.drop_leaks(spark, docs, bench).collect()) == ["b", "c", "f"]
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(docs, bench).collect()) == ["1", "None"]


def test_documents_with_leaks_go(spark):
    docs = spark.createDataFrame([(1, QUESTION, "a"), (2, "clean text of several words that nobody asked for", "b"), (3, None, "c"), (None, "x", "d")], "doc_id long, text string, window string")
    bench = spark.createDataFrame([(0, QUESTION)], "item_id long, text string")
    out = decontaminate.drop_leaks(spark, docs, bench)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None"]


def containments(text, templates):
    """Brute force: every window of every template, all shingles."""
    out = {}
    w = licenses.template_words(text or "")
    for name, t in templates.items():
        tw = licenses.template_words(t)
        k = min(licenses.SHINGLE, len(tw))
        want = set(licenses.template_shingles(tw, k))
        own = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        step = licenses.stride(len(tw))
        wide = max(1, len(tw) + step - k)
        best = max((len(want & set(own[i : i + wide])) / len(want) for i in range(0, len(own), step)), default=0)
        if best >= licenses.CONTAINMENT:
            out[name] = round(best, 6)
    return out


def test_licenses_against_brute_force(spark):
    from tests.llm.conftest import words

    texts = [None, "", "no license here at all", "words " * 50]
    for i, t in enumerate(licenses.TEMPLATES.values()):
        own = t.split()
        texts.append(words(30 + i, i) + "\n" + t + "\n" + words(40, 50 + i))
        texts.append(words(9, i) + " " + " ".join(own[: max(1, len(own) * 9 // 10)]) + " " + words(9, i))
        texts.append(" ".join([*own[: len(own) // 2], "changed", *own[len(own) // 2 + 1 :]]) * 2)
    texts += [texts[4]] * 3
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("sh", F.lit(1))).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = round(r.containment, 6)
    want = {i: c for i, t in enumerate(texts) if (c := containments(t, licenses.TEMPLATES))}
    assert got == want and len(want) > 20


def test_triggers_lose_nothing():
    words = licenses.triggers(licenses.TEMPLATES)
    for t in licenses.TEMPLATES.values():
        w = licenses.template_words(t)
        shingles = licenses.template_shingles(w, licenses.SHINGLE)
        without = [s for s in shingles if not set(s.split()) & set(words)]
        assert len(without) < licenses.CONTAINMENT * len(shingles)


def test_bands_meet_almost_surely():
    for t in licenses.TEMPLATES.values():
        low = licenses.least_similarity(len(licenses.template_words(t)))
        assert 1 - (1 - low) ** licenses.BANDS > 0.999


def test_templates_in_several_passes(spark, monkeypatch):
    """Any number of templates: so many a pass."""
    docs = spark.createDataFrame([(1, "x " + licenses.TEMPLATES["mit-whole"] + " y"), (2, "a b c " + licenses.TEMPLATES["cc-by-4.0-line"]), (3, None), (4, licenses.TEMPLATES["isc-whole"])], "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.license_id, round(r.containment, 6), r.first_word, r.windows) for r in rows)
    once = key(licenses.scan(docs).collect())
    assert {(1, "mit-whole"), (2, "cc-by-4.0-line"), (4, "isc-whole")} <= {r[:2] for r in once}
    monkeypatch.setattr(licenses, "PASS_TEMPLATES", 3)
    assert key(licenses.scan(docs).collect()) == once
