"""Language ID by compression: the language whose zstandard dictionary makes the text smallest.

Each language has a raw-content dictionary of ``dictionary_bytes``, filled from a bounded sample
of labelled rows: about ``sample_rows`` of each language, by a hash of doc_id and text; rows that come
again count once.  Of a sampled text one piece is taken, from a place that the hash chooses.
A text is lower-cased, cut into chunks (the whole text, each byte in one chunk) and every chunk
compressed alone with every dictionary, so that a long text does not outweigh the dictionary by
its own repeats.  The language with the fewest bytes wins; ties go to the one with more labelled
rows, then to the smaller name.

score is how much smaller the best is than the second best (0 to 1; 1 if one language is known).
Margins below ``margin`` are rejected at every length: accepted is false.  Null texts and
texts without a letter get `und`, score 0, and are rejected.  Nothing but the text is an input of a prediction.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.blobs import trim
from quire.runtime import ship

SAMPLE_ROWS, DICTIONARY_BYTES, CHUNK, MARGIN = 400, 110_000, 4096, 0.004
# Short matches and a short search: close languages differ in short words.
SEARCH = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 2, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
LETTER = regex.compile(r"\p{L}")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows; rows without text or label are skipped.

    The sample is all rows whose hash is under a bound that leaves about sample_rows of each
    language, so one pass finds it and its size doesn't follow the table's.
    """
    labelled = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return {}
    hashed = F.xxhash64(F.col(key), F.col(text))
    place = F.pmod(hashed, F.lit(1 << 40))
    bound = reduce(lambda c, x: c.when(F.col(lang) == x[0], F.lit(min(1 << 40, (sample_rows << 40) // x[1]))), counts.items(), F)
    share = -(-dictionary_bytes // sample_rows) * 4
    begin = F.pmod(F.xxhash64(hashed), F.greatest(F.lit(1), F.length(F.col(text)) - share + 1)).cast("int") + 1
    picked = labelled.filter(place < bound).select(F.col(lang).alias("lang"), hashed.alias("place"), F.substring(F.col(text), begin, F.lit(share)).alias("text"))
    parts: dict[str, list[bytes]] = {x: [] for x in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sorted(picked.groupBy("lang", "place").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["place"], r["text"])):
        parts[r["lang"]].append(r["text"].lower().encode())
    out = {}
    for name, texts in parts.items():
        each = max(64, dictionary_bytes // max(1, len(texts)))
        first = b"\n".join(x[:each] for x in texts)
        rest = b"\n".join(x[each:] for x in texts)
        out[name] = (rest[: max(0, dictionary_bytes - len(first))] + b"\n" + first)[-dictionary_bytes:]
    return out


def _classifier(dictionaries: dict[str, bytes], chunk: int = CHUNK, margin: float = MARGIN):
    """A function that gives lang_pred, score and accepted of texts; its compressors last as long as it does."""
    names, how = list(dictionaries), zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    tools = []
    for name in names:
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def classify(texts: list[str | None]) -> list[pa.Array]:
        lang, score, good = [], [], []
        for text in texts:
            if not names or text is None or not LETTER.search(text):
                lang.append("und"), score.append(0.0), good.append(False)
                continue
            data = text.lower().encode()
            parts = [data] if len(data) <= chunk else [data[i : i + chunk] for i in range(0, len(data), chunk)]
            size = [sum(len(f(x)) for x in parts) for f in tools]
            best = min(range(len(size)), key=size.__getitem__)
            second = min((x for i, x in enumerate(size) if i != best), default=0)
            by = (second - size[best]) / second if second else 1.0
            lang.append(names[best]), score.append(by), good.append(by >= margin)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(good, pa.bool_())]

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: dict[str, Column], text: str = "text", chunk: int = CHUNK, margin: float = MARGIN) -> DataFrame:
    """The columns of keep, then lang_pred, score and accepted, one row per input row."""
    ship(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double, accepted boolean"])
    names = list(keep)

    def run(batches):
        classify = _classifier(dictionaries, chunk, margin)
        for batch in batches:
            found = classify(batch.column(len(names)).to_pylist())
            trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*names, "lang_pred", "score", "accepted"])
        del classify
        trim()

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; accepted says if the margin is wide enough."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    return identify(docs, fit(docs.filter(~out)), {"doc_id": F.col("doc_id").cast("long"), "held_out": out})


def keep_known(spark, docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their own columns."""
    ship(spark)
    dictionaries, at = fit(docs), docs.columns.index("text")

    def run(batches):
        classify = _classifier(dictionaries)
        for batch in batches:
            yield batch.filter(classify(batch.column(at).to_pylist())[2])
            trim()
        del classify
        trim()

    return docs.mapInArrow(run, docs.schema)
