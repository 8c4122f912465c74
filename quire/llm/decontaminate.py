"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become lower-case words (letters and digits); numbers, units behind a number, and
capitalised words inside a sentence become typed slots that keep their value aside.  A *template
window* is ``WINDOW`` consecutive words with slots reduced to their types; a window of nothing but slots
keeps their values.  Every window of every document is hash-joined to the windows of the benchmark.

The windows that a text shares with an item form *occurrences*: those of one shift between text and item;
those of a run of neighbouring shifts, each at most NEAR words from the next; and all of them.  A text holds
the item when in one occurrence the windows cover ``COVERAGE`` of the item's words (and ``LEAST_WORDS`` of
them, or all words of a shorter item) and the slots inside these windows fit: each value of the item stands for
one value of the text.  So re-parameterised questions are found, chance frames are not, and a second version of
a question or a chance window elsewhere hides nothing.  n_covered counts the windows of the whole text.

Null texts and items of fewer than WINDOW words match nothing.  Each text is judged by itself, also where
texts share a doc_id or have none; the report has one row for each doc_id (null is one) and item, with the
fullest coverage, and dropping goes by text.  Repeated items are reported under their own ids.  Other columns
are not read.  The benchmark's windows are broadcast only while their number is below ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize

WINDOW, COVERAGE, LEAST_WORDS, BROADCAST_ROWS = 5, 0.5, 8, 200_000
NEAR = 3  # words put in or left out between two windows of one occurrence
# Units that count as such behind a number.
UNITS = "km kg cm mm mg ml g m l s h t percent meters metres miles feet inches pounds ounces grams kilograms kilometers kilometres liters litres seconds minutes hours days weeks months years dollars euros cents degrees"
MARK = "\x02"


def canonical_words(text: Column) -> Column:
    """The words of a text; a slot is the mark, n, u or a, and its value."""
    t = F.regexp_replace(text, "([0-9]+)", f" {MARK}n$1 ")
    t = F.regexp_replace(t, f"({MARK}n[0-9]+ +)({UNITS.replace(' ', '|')})([^\\p{{L}}\\p{{N}}]|$)", f"$1{MARK}u$2$3")
    for _ in range(2):  # once more for a name's second word
        t = F.regexp_replace(t, "([\\p{Ll}\\p{N},;)] )(\\p{Lu}\\p{L}*)", f"$1{MARK}a$2")
    return F.filter(F.split(F.lower(t), f"[^\\p{{L}}\\p{{N}}{MARK}]+"), lambda w: w != "")


def _windows(words: Column, names: Column, window: int) -> Column:
    """For each window its key and, where it has a slot, its words; none where there are too few words."""
    at = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        slots = [F.get(names, i + k) < 0 for k in range(window)]
        some, every = reduce(lambda a, b: a | b, slots), reduce(lambda a, b: a & b, slots)
        held = F.when(some, F.slice(words, i + 1, window))
        key = F.when(every, F.xxhash64(F.slice(words, i + 1, window))).otherwise(F.xxhash64(*[F.get(names, i + k) for k in range(window)]))
        return F.struct(key.alias("window"), held.alias("held"))

    return F.transform(at, one)


def windows(rows: DataFrame, keys: dict[str, Column], text: Column, window: int, as_pos: str, as_held: str) -> DataFrame:
    """The keys, place, hash and slot words of every template window of every row; names of slots are negative."""
    words = rows.select(*[c.alias(k) for k, c in keys.items()], canonical_words(text).alias("words"))
    name = lambda w: F.when(w.startswith(MARK), -F.ascii(F.substring(w, 2, 1)).cast("long")).otherwise(F.abs(F.xxhash64(w)))
    named = words.select(*keys, "words", F.transform("words", name).alias("names"))
    each = named.select(*keys, F.posexplode(_windows(F.col("words"), F.col("names"), window)).alias(as_pos, "w"))
    return each.select(*keys, as_pos, F.col("w.window").alias("window"), F.col("w.held").alias(as_held))


def _covered(window: int) -> Column:
    """How many words of the item the windows of a group cover; an item's places bound the set."""
    at = F.collect_set("item_at")
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, a + window - 1)))))


def held_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash, item_id, n_words (of the item), n_covered, n_slots: a row for each text and item that it holds."""
    items = benchmark.select(F.col(item_id).alias("item_id"), canonical_words(F.col(item_text)).alias("words")).filter(F.size("words") >= window)
    slots = F.size(F.filter("words", lambda w: w.startswith(MARK)))
    sizes = items.groupBy("item_id").agg(F.max(F.size("words")).alias("n_words"), F.max(slots).alias("n_slots"))
    theirs = materialize(windows(benchmark, {"item_id": F.col(item_id)}, F.col(item_text), window, "item_at", "item_held"), "benchmark-windows")
    small = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ours = windows(docs, {"doc_id": F.col(doc_id), "text_hash": F.xxhash64(F.col(text))}, F.col(text), window, "doc_at", "doc_held")
    text_item = ["doc_id", "text_hash", "item_id"]
    hits = ours.join(F.broadcast(theirs) if small else theirs, "window").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    # rows that come again count once; equal keys have equal words, so any of them will do
    hits = materialize(hits.groupBy(*text_item, "item_at", "shift").agg(F.first("item_held").alias("item_held"), F.first("doc_held").alias("doc_held")), "hits")
    enough = (F.col("n_covered") >= coverage * F.col("n_words")) & (F.col("n_covered") >= F.least(F.lit(least_words), F.col("n_words")))
    found = hits.groupBy(*text_item).agg(_covered(window).alias("n_covered"))
    found = materialize(found.join(F.broadcast(sizes) if small else sizes, "item_id").filter(enough), "covered")

    same = F.col("f.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("f.text_hash") == F.col("h.text_hash")) & (F.col("f.item_id") == F.col("h.item_id"))
    parts = hits.alias("h").join(found.alias("f"), same).select("h.*", "f.n_words")
    shifts = Window.partitionBy(*text_item).orderBy("shift")
    opens = F.coalesce(F.col("shift") - F.lag("shift").over(shifts) > NEAR, F.lit(True)).cast("int")
    parts = parts.withColumn("opens", opens).withColumn("run", F.sum("opens").over(shifts))
    kinds = {"all": F.lit(0), "shift": F.col("shift"), "run": F.col("run")}
    occurrence = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("long").alias("of")) for k, c in kinds.items()]))
    parts = parts.select(*text_item, "n_words", "item_at", "item_held", "doc_held", occurrence.alias("occurrence"))
    values = F.explode_outer(F.filter(F.arrays_zip("item_held", "doc_held"), lambda p: p["item_held"].startswith(MARK)))
    values = parts.select(*text_item, "occurrence", "n_words", "item_at", values.alias("value"))
    # for each value of the item (null: none) whether it meets two words, then for each occurrence
    per_value = values.groupBy(*text_item, "occurrence", "n_words", F.col("value.item_held").alias("value")).agg((F.min("value.doc_held") < F.max("value.doc_held")).alias("two"), F.collect_set("item_at").alias("at"))
    flat = F.flatten(F.collect_list("at"))  # at most a set of the item's places for each of its values
    places = F.array_distinct(F.flatten(F.transform(flat, lambda a: F.sequence(a, a + window - 1))))
    judged = per_value.groupBy(*text_item, "occurrence", "n_words").agg(F.size(places).alias("n_covered"), F.coalesce(F.bool_or("two"), F.lit(False)).alias("broken"))
    good = judged.filter(enough & ~F.col("broken")).select(*text_item).distinct()
    same = F.col("f.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("f.text_hash") == F.col("g.text_hash")) & (F.col("f.item_id") == F.col("g.item_id"))
    return found.alias("f").join(good.alias("g"), same, "left_semi").select(*text_item, *[F.col(c).cast("long").alias(c) for c in ("n_words", "n_covered", "n_slots")])


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_covered, n_slots: one row for each item that a document holds.  how: as in held_items."""
    return held_items(docs, benchmark, **how).groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("n_words", "n_covered", "n_slots")])


def op5_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every item of benchmark."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text holds no item."""
    held = materialize(held_items(docs, benchmark).select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).distinct(), "held")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["held_id"]) & (F.xxhash64(docs["text"]) == held["held_hash"]), "left_anti")


OP5_SQL = f"""
WITH src AS (
  SELECT 0 AS kind, row_number() OVER () AS rid, doc_id AS id, text FROM (SELECT DISTINCT doc_id, text FROM documents) UNION ALL SELECT 1, item_id, item_id, text FROM benchmark
), marked AS (
  SELECT kind, rid, id, regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(text, '([0-9]+)', ' ' || chr(2) || 'n\\1 ', 'g'),
      '(\\x02n[0-9]+ +)({UNITS.replace(" ", "|")})([^\\p{{L}}\\p{{N}}]|$)', '\\1' || chr(2) || 'u\\2\\3', 'g'),
    '([\\p{{Ll}}\\p{{N}},;)] )(\\p{{Lu}}\\p{{L}}*)', '\\1' || chr(2) || 'a\\2', 'g'),
    '([\\p{{Ll}}\\p{{N}},;)] )(\\p{{Lu}}\\p{{L}}*)', '\\1' || chr(2) || 'a\\2', 'g') AS t FROM src
), words AS (
  SELECT kind, rid, id, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}\\x02]+'), lambda w: w <> '') AS w FROM marked
), win AS (
  SELECT kind, rid, pos, CASE WHEN len(list_filter(v, lambda x: x[1] = chr(2))) = {WINDOW} THEN '=' || array_to_string(v, ' ')
    ELSE array_to_string(list_transform(v, lambda x: CASE WHEN x[1] = chr(2) THEN x[1:2] ELSE x END), ' ') END AS k
  FROM (SELECT kind, rid, i - 1 AS pos, w[i:i + {WINDOW - 1}] AS v FROM (SELECT kind, rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW}))
), hits AS (
  SELECT DISTINCT d.rid, b.rid AS item_id, b.pos AS item_at, d.pos AS doc_at, d.pos - b.pos AS shift FROM win d JOIN win b ON d.k = b.k AND d.kind = 0 AND b.kind = 1
), sizes AS (
  SELECT rid AS item_id, max(len(w)) AS n_words, max(len(list_filter(w, lambda x: x[1] = chr(2)))) AS n_slots FROM words WHERE kind = 1 GROUP BY 1
), cells AS (
  SELECT DISTINCT rid, item_id, shift, item_at + o AS item_at, doc_at + o AS doc_at FROM hits, (SELECT unnest(range(0, {WINDOW})) AS o)
), cov AS (
  SELECT rid, item_id, count(DISTINCT item_at) AS n_covered FROM cells GROUP BY 1, 2
), likely AS (
  SELECT c.*, z.n_words, z.n_slots FROM cov c JOIN sizes z USING (item_id) WHERE n_covered >= {COVERAGE} * n_words AND n_covered >= least({LEAST_WORDS}, n_words)
), sh AS (
  SELECT DISTINCT rid, item_id, shift FROM hits SEMI JOIN likely USING (rid, item_id)
), lows AS (
  SELECT * FROM sh a WHERE NOT EXISTS (SELECT 1 FROM sh b WHERE b.rid = a.rid AND b.item_id = a.item_id AND b.shift BETWEEN a.shift - {NEAR} AND a.shift - 1)
), highs AS (
  SELECT * FROM sh a WHERE NOT EXISTS (SELECT 1 FROM sh b WHERE b.rid = a.rid AND b.item_id = a.item_id AND b.shift BETWEEN a.shift + 1 AND a.shift + {NEAR})
), spans AS (
  SELECT rid, item_id, min(shift) AS low, max(shift) AS high FROM sh GROUP BY 1, 2
  UNION SELECT rid, item_id, shift, shift FROM sh
  UNION SELECT l.rid, l.item_id, l.shift, min(h.shift) FROM lows l JOIN highs h ON h.rid = l.rid AND h.item_id = l.item_id AND h.shift >= l.shift GROUP BY 1, 2, 3
), inside AS (
  SELECT s.rid, s.item_id, s.low, s.high, c.item_at, i.w[c.item_at + 1] AS value, d.w[c.doc_at + 1] AS word
  FROM spans s JOIN cells c ON c.rid = s.rid AND c.item_id = s.item_id AND c.shift BETWEEN s.low AND s.high
  JOIN words i ON i.kind = 1 AND i.rid = s.item_id JOIN words d ON d.kind = 0 AND d.rid = s.rid
), broken AS (
  SELECT DISTINCT rid, item_id, low, high FROM inside WHERE value[1] = chr(2) GROUP BY rid, item_id, low, high, value HAVING count(DISTINCT word) > 1
), good AS (
  SELECT DISTINCT rid, item_id FROM (SELECT rid, item_id, low, high, count(DISTINCT item_at) AS n FROM inside GROUP BY ALL) JOIN sizes USING (item_id) ANTI JOIN broken USING (rid, item_id, low, high)
  WHERE n >= {COVERAGE} * n_words AND n >= least({LEAST_WORDS}, n_words)
)
SELECT w.id AS doc_id, l.item_id, CAST(max(n_words) AS BIGINT) AS n_words, CAST(max(n_covered) AS BIGINT) AS n_covered, CAST(max(n_slots) AS BIGINT) AS n_slots
FROM likely l JOIN good g ON g.rid = l.rid AND g.item_id = l.item_id JOIN words w ON w.kind = 0 AND w.rid = l.rid GROUP BY 1, 2
"""
