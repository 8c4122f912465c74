"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct shingles.  Shingles have one global order, by the number of documents that hold them and
then by name.  A link of two sets of a and b shingles needs T = ceil(9 (a + b) / 19) common ones (for 90 %).  If it has them, the first
a - T + l of the one and the first b - T + l of the other have at least l in common, for every l up to T.  Each document chooses its
own l: a longer prefix meets more documents by a single shingle, but asks that l of them agree before a pair is
verified.  The choice is the least estimated cost, SCAN for each row that the prefix's shingles meet, and VERIFY for each
candidate, of which there are at most rows / l.  A pair goes by the smaller l of its two documents.

Equal sets enter as one.  First every document of a shingle is compared with one centre of it, for a few rounds with other centres, and
linked documents form components; then *all* pairs of documents of different components that share enough of their
prefixes are verified.  So a family of thousands of near copies costs about as much as it has members, and no link between two
components is left out: a document's component is that of the full join.  Links inside a component are not listed.

Counts by shingle travel as packed arrays, one for each (chunk of documents, shard of names), and shards answer in kind.  Shingles go
by 64-bit names, counts by the shard and 32 bits of the name: a collision there makes an estimate too high and nothing else.

Words are runs of other bytes than blank and 9 to 13, A-Z lower-cased.  With fewer words than a shingle has, the whole
sequence is the one shingle.  Nulls and texts without words have no shingle and no link: the component is their own doc_id.  A null doc_id
has none.  Rows of one doc_id link each by its own text, and the id gets the smallest component.  Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blobs import BUCKET_BYTES, U, deal, pack, trim, unpack
from quire.llm.near_dedup import components, shingles
from quire.runtime import materialize, ship

SHINGLE = 3
SIMILARITY = 90  # per cent
MOST = 8  # the longest l
SCAN, VERIFY = 1.0, 30.0
ROUNDS = 3
MEMBERS = 500  # pairs that one copy of a set is sent for
CHUNKS = "chunk string, ids array<long>, nodes array<long>, sizes array<long>, lengths array<int>, texts binary"
KEYS = "chunk string, shard long, keys binary, counts binary"
ANSWERS = "chunk string, shard long, counts binary"
PREFIXES = "id long, doc long, size long, l int, names array<long>, places array<int>"


def needed(a, b, percent: int):
    """Common shingles of two linked sets of a and b, at least; numbers, arrays or Columns."""
    whole = percent * (a + b) + 100 + percent - 1
    return F.floor(whole / (100 + percent)) if hasattr(whole, "isNull") else whole // (100 + percent)


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and name of each distinct shingle, sorted by both."""
    with np.errstate(over="ignore"):
        doc, name, _ = shingles([x.lower() for x in texts], size)  # of bytes: A-Z only
    return doc, name


def _node(name: np.ndarray) -> int:
    """The name of a set."""
    return int.from_bytes(hashlib.blake2b(name.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chunks(size: int):
    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def close(ids, texts):
            nonlocal n
            doc, name = _sets(texts, size)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            nodes = [_node(name[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            row = [f"{task}-{n}"], [ids], [nodes], [np.diff(edge).tolist()], [[len(x) for x in texts]], [zstandard.compress(b"".join(texts), 1)]
            n += 1
            kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["chunk", "ids", "nodes", "sizes", "lengths", "texts"])

        ids, texts, held = [], [], 0
        for batch in batches:
            trim()
            for i, x in zip(batch["doc"].to_pylist(), batch["text"]):
                x = (x.as_py() or "").encode()
                if texts and held + len(x) > BUCKET_BYTES:
                    yield close(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(x)
                held += len(x)
        if texts:
            yield close(ids, texts)

    return run


def _texts(lengths: list[int], blob: bytes) -> list[bytes]:
    whole, at, out = zstandard.decompress(blob), 0, []
    for n in lengths:
        out.append(whole[at : at + n])
        at += n
    return out


def _keys(size: int, shards: int):
    """How many documents of a chunk hold each name, a row for each shard that has some."""
    step = U((1 << 64) // shards + 1)

    def run(batches):
        for batch in batches:
            for chunk, lengths, blob in zip(batch["chunk"].to_pylist(), batch["lengths"].to_pylist(), batch["texts"]):
                trim()
                name, count = np.unique(_sets(_texts(lengths, blob.as_buffer()), size)[1], return_counts=True)
                if not len(name):
                    continue
                shard = name // step
                first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                ends = np.append(first[1:], len(name))
                rows = [[chunk] * len(first), shard[first].astype(np.int64), [pack(name[a:b].astype(np.uint32)) for a, b in zip(first, ends)], [pack(count[a:b].astype(np.uint32)) for a, b in zip(first, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["chunk", "shard", "keys", "counts"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    """The documents of each key of a shard, to every chunk in the order in which it sent them."""
    trim()
    keys = [unpack(x.as_buffer(), np.uint32) for x in table["keys"]]
    counts = np.concatenate([unpack(x.as_buffer(), np.uint32) for x in table["counts"]])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=counts)[place].astype(np.uint32)
    cut = np.cumsum([0, *map(len, keys)])
    return pa.table([table["chunk"], table["shard"], pa.array([pack(total[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["chunk", "shard", "counts"])


def prefixes(start: np.ndarray, size: np.ndarray, held: np.ndarray, percent: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The l and the prefix of each document; held: the documents of its shingles, in the global order from start on."""
    least = -(-percent * size // 100)  # what the smallest partner needs
    cost = np.concatenate([[0], np.cumsum(held - 1.0)])
    best, choice = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for length in range(1, most + 1):
        rows = cost[start + np.minimum(size - least + length, size)] - cost[start]
        price = SCAN * rows + VERIFY * rows / length
        better = (price < best) & (length <= least)
        best[better], choice[better] = price[better], length
    return choice, np.minimum(size - least + choice, size)


def _prefixes(size: int, percent: int):
    def run(key, answers: pa.Table, chunk: pa.Table) -> pa.Table:
        trim()
        out = [[], [], [], [], [], []]
        if chunk.num_rows and answers.num_rows:
            lengths, ids, nodes = (chunk[c][0].as_py() for c in ("lengths", "ids", "nodes"))
            doc, name = _sets(_texts(lengths, chunk["texts"][0].as_buffer()), size)
            order = np.argsort(answers["shard"].to_numpy())
            counts = np.concatenate([unpack(answers["counts"][int(i)].as_buffer(), np.uint32) for i in order])
            held = counts[np.unique(name, return_inverse=True)[1]].astype(np.int64)
            order = np.lexsort((name, held, doc))
            name, held = name[order], held[order]
            n = np.bincount(doc, minlength=len(ids))
            start = np.cumsum(n) - n
            some = np.flatnonzero(n)
            choice, reach = prefixes(start[some], n[some], held, percent)
            for i, length, to in zip(some.tolist(), choice.tolist(), reach.tolist()):
                if ids[i] is None:
                    continue
                a = start[i]
                shared = np.flatnonzero(held[a : a + to] > 1)  # a shingle of one document meets nobody
                for column, value in zip(out, (nodes[i], ids[i], int(n[i]), length, name[a + shared].view(np.int64), shared.astype(np.int32))):
                    column.append(value)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "doc", "size", "l", "names", "places"])

    return run


def _named(size: int):
    """Name and set of each text."""

    def run(batches):
        for batch in batches:
            trim()
            texts = [(x or "").encode() for x in batch["text"].to_pylist()]
            doc, name = _sets(texts, size)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [name[a:b] for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            trim()
            keep, last, x = [], None, None
            for i, (a, b) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                a = a.as_buffer()
                if last is None or not a.equals(last):
                    last, x = a, np.frombuffer(a, U)
                y = np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are linked.  A set that is in many pairs is sent in copies, each for MEMBERS of them."""
    copies = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "join-copies")
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
    left = copies.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "set_a")
    right = salted.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return materialize(right.join(left, ["a", "salt"]).select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"), "join-links")


def _with_parts(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("part", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("part", F.coalesce("label", "id")).drop("label")


def _reach(x: str, percent: int, length):
    """The length of the prefix of side x of a pair in which the pair, if linked, shares that many shingles."""
    return F.col(f"size_{x}") - needed(F.col("size_a") + 0, F.col("size_b"), percent) + length


def _fits(percent: int):
    """Whether a shared shingle of a and b stands in the shortest prefixes of the pair, and their sizes allow a link."""
    inside = [F.col(f"place_{x}") < _reach(x, percent, 1) for x in "ab"]
    return inside[0] & inside[1] & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))


def _stars(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of each shingle's members with one centre, a member of its largest component; not those of one component.

    The first centre is the member with the fewest rarer shingles, which differs least from the others; later ones are dealt by k.
    """
    order = F.struct(F.xxhash64("id", F.lit(k)) if k else -F.col("place").cast("long"), "id", "size")
    heads = rows.groupBy("name", "part").agg(F.max(order).alias("head"), F.count("*").alias("n"))
    top = heads.groupBy("name").agg(F.max(F.struct("n", "head", "part")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    names = ("head", "part")
    top = materialize(top.select("name", *[F.col(f"top.{c}").alias(f"{c}_a") for c in names]), "join-centres")
    near = rows.join(top, "name").filter("part <> part_a")
    near = near.withColumn("a", F.col("head_a.id")).filter(100 * F.least("size", "head_a.size") >= percent * F.greatest("size", "head_a.size"))
    return near.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).filter("a <> b").distinct()


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share as many shingles of their prefixes as the smaller l of the two.

    They share one in the prefixes for l = 1 too, which are the shortest: that is what they are met by.
    Of each shingle, members outside its largest component are paired with the members of other components.
    """
    parts = rows.groupBy("name", "part").agg(F.count("*").alias("n"))
    parts = parts.groupBy("name").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("rest"))
    parts = materialize(parts.filter("parts > 1").select("name", "largest", F.ceil(F.col("rest") / MEMBERS).cast("int").alias("salts")), "join-names")
    rows = rows.join(parts, "name")
    columns = ("id", "part", "size", "l", "place")
    one = rows.filter("part <> largest").select("name", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in columns])
    two = rows.select("name", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "largest", *[F.col(c).alias(f"{c}_b") for c in columns])
    once = (F.col("part_b") == F.col("largest")) | (F.col("id_a") < F.col("id_b"))
    met = one.join(two, ["name", "salt"]).filter((F.col("part_a") != F.col("part_b")) & once & _fits(percent))
    length = F.least("l_a", "l_b")
    pairs = met.select("id_a", "id_b", length.alias("l"), _reach("a", percent, length).alias("reach_a"), _reach("b", percent, length).alias("reach_b"))
    pairs = materialize(pairs.groupBy("id_a", "id_b").agg(*[F.first(c).alias(c) for c in ("l", "reach_a", "reach_b")]), "join-candidates")
    # one shared shingle in the shortest prefixes is sure to be there; the longer ones are looked through for l of them
    held = {x: rows.select(F.col("id").alias(f"id_{x}"), "name", F.col("place").alias(f"place_{x}")) for x in "ab"}
    more = pairs.filter("l > 1").join(held["a"], "id_a").filter("place_a < reach_a").join(held["b"], ["id_b", "name"]).filter("place_b < reach_b")
    enough = more.groupBy("id_a", "id_b", "l").agg(F.count("*").alias("shared")).filter("shared >= l").select("id_a", "id_b")
    found = pairs.filter("l = 1").select("id_a", "id_b").unionByName(enough)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    _, shards = deal(own, "text")
    chunks = materialize(own.mapInArrow(_chunks(shingle), CHUNKS), "join-chunks")
    every = chunks.select(F.explode(F.arrays_zip("ids", "nodes", "sizes")).alias("d")).select(F.col("d.ids").alias("doc"), F.col("d.nodes").alias("id"), F.col("d.sizes").alias("size"))
    # id: the name of a set.  Tables between an aggregation and the join with it: so a hot key's rows can be dealt to several tasks
    some = every.filter("doc is not null and size > 0")
    heads = materialize(some.groupBy("id").agg(F.min("doc").alias("doc")), "join-heads")
    member = materialize(some.select("doc", "id").distinct(), "join-members")

    answers = chunks.select("chunk", "lengths", "texts").mapInArrow(_keys(shingle, shards), KEYS).groupBy("shard").applyInArrow(_answers, ANSWERS)
    chosen = answers.groupBy("chunk").cogroup(chunks.select("chunk", "ids", "nodes", "lengths", "texts").groupBy("chunk")).applyInArrow(_prefixes(shingle, percent), PREFIXES)
    chosen = materialize(chosen.filter("size(names) > 0"), "join-prefixes")
    chosen = chosen.join(heads.hint("merge"), ["id", "doc"], "left_semi").dropDuplicates(["id", "doc"])
    rows = materialize(chosen.select("id", "size", "l", F.explode(F.arrays_zip("names", "places")).alias("p")).select("id", "size", "l", F.col("p.names").alias("name"), F.col("p.places").alias("place")), "join-rows")
    shared = materialize(rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "join-shared")
    rows = materialize(rows.join(shared, "name"), "join-met")
    wanted = materialize(rows.select("id").distinct().join(heads, "id").select("doc").distinct(), "join-wanted")
    sets = own.join(wanted.hint("merge"), "doc", "left_semi").mapInArrow(_named(shingle), "id long, set binary")
    sets = materialize(sets.groupBy("id").agg(F.min("set").alias("set")), "join-sets")

    # the sets of one doc_id are linked by it
    several = materialize(member.groupBy("doc").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("doc", "a"), "join-several")
    links = materialize(member.join(several, "doc").filter("a <> id").select("a", F.col("id").alias("b")), "join-own-links")
    labels = components(links, "join-labels") if links.limit(1).count() else None
    for k in range(rounds + 1):
        parted = _with_parts(rows, labels)
        pairs = materialize(_across(parted, percent) if k == rounds else _stars(parted, k, percent), "join-pairs")
        found = verified(pairs, sets, percent)
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links, "join-labels")
    placed = materialize(_with_parts(member, labels), "join-placed")
    least = materialize(placed.groupBy("part").agg(F.min("doc").alias("component_id")), "join-components")
    of = placed.join(least, "part").select("doc", "component_id").distinct()
    return every.join(of, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 90 % of their 3-word shingles."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Another way: every pair of different sets that share any shingle, and smallest ids by steps along the links.
OP11_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, row, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM doc),
size AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n, hash(list(g ORDER BY g)) AS h FROM gram GROUP BY row),
head AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM size WHERE doc_id IS NOT NULL GROUP BY h),
few AS (SELECT DISTINCT s.h, g.g FROM gram g JOIN size s USING (row) WHERE s.doc_id IS NOT NULL),
met AS (SELECT x.h AS a, y.h AS b, count(*) AS i FROM few x JOIN few y ON x.g = y.g AND x.h < y.h GROUP BY x.h, y.h),
link AS (SELECT x.rep AS a, y.rep AS b FROM met JOIN head x ON x.h = a JOIN head y ON y.h = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT rep, doc_id FROM size JOIN head USING (h) UNION SELECT doc_id, rep FROM size JOIN head USING (h)),
reach AS (SELECT a AS id, a AS label FROM twoway UNION SELECT twoway.b, reach.label FROM reach JOIN twoway ON twoway.a = reach.id WHERE reach.label < twoway.b),
least AS (SELECT id, min(label) AS label FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.label, d.doc_id) AS component_id FROM doc d LEFT JOIN size s USING (row) LEFT JOIN least l ON l.id = d.doc_id
"""
