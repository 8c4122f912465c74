"""MinHash near-dedup by ProbMinHash, banding and verification.

A document is its set of ``shingle`` consecutive words (all its words if it has fewer), each
weighted with 1 + ln(times it occurs).  ProbMinHash gives every shingle a Poisson process whose
rate is its weight; each arrival falls on a random register, and a register keeps the shingle
that arrives first.  A shingle whose next arrival is later than every register of its document
is done (early termination).  Two registers agree with the probability Jaccard similarity.

Bands of registers put documents into buckets.  Inside a bucket documents are not paired with
each other but with one centre, the member that shares most bands with others, so candidates
grow with the members; each candidate is verified by the exact probability Jaccard similarity of its
weighted shingles, which is what the registers estimate; without repeated shingles it is that of the sets.
Verified links form components; the next rounds pair a member of the largest component of a
bucket with the members of its other components.  Then every pair that shares a bucket, lies in two
components and was not compared is verified, unless a bound on its similarity rules it out.  So no pair that
banding finds is left out.
Texts of the same words and order enter as one document.

Nulls and texts without a word are nobody's duplicate.  Rows with the same doc_id count as one
document if their texts are equal, else each text joins its own class and the id gets the
smaller class.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.blobs import U, mix, trim
from quire.llm.words import Words, windows
from quire.runtime import materialize, ship

SHINGLE, SIMILARITY, BANDS, ROWS, ROUNDS = 5, 0.8, 16, 4, 3
BASE = 0x9FB21C651E98DF25
CHUNK = 1_000_000  # bytes of text handled at once
MEMBERS = 500  # partners that one copy of a centre's shingles serves


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, shingle name and count, by text and name; a text of fewer words has one shingle."""
    w = Words(texts)
    h = w.hashes()
    n = len(h)
    fits = np.arange(n) + size <= (w.begin + w.count)[w.doc] if n else np.zeros(0, bool)
    at = np.flatnonzero(fits)
    doc, name = w.doc[at], windows(h, size, BASE)[at] if len(at) else np.zeros(0, U)
    few = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(few):
        whole = np.array([int(mix(np.array([np.bitwise_xor.reduce(mix(h[b : b + c] + np.arange(c, dtype=U)))], U))[0]) for b, c in zip(w.begin[few], w.count[few], strict=True)], U)
        doc, name = np.concatenate([doc, few]), np.concatenate([name, whole])
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    return doc[first], name[first], np.diff(np.append(first, len(doc)))


def prob_minhash(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers (docs, m): the shingle that arrives first on each; zeros for a text without shingles."""
    when = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, U)
    live, time, k = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(live):
        draw = mix(name[live] + U((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time[live] -= np.log(((draw >> U(11)).astype(np.float64) + 1) * 2.0**-53) / weight[live]
        seat = doc[live] * m + (mix(draw ^ U(0x2545F4914F6CDD1D)) % U(m)).astype(np.int64)
        np.minimum.at(when, seat, time[live])
        won = when[seat] == time[live]
        who[seat[won]] = name[live[won]]
        latest = when.reshape(docs, m).max(axis=1)
        live = live[time[live] < latest[doc[live]]]
        k += 1
    return who.reshape(docs, m)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of a batch of CHUNK bytes of text or one row."""
    for batch in batches:
        trim()
        texts = [(x or "").encode() for x in batch["text"].to_pylist()]
        at = held = 0
        for i, x in enumerate(texts):
            if i > at and held + len(x) > CHUNK:
                yield batch.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(x)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def _signatures(size: int, bands: int, rows: int):
    def run(batches):
        for batch, texts in _chunks(batches):
            with np.errstate(over="ignore"):
                doc, name, count = shingles(texts, size)
                signature = prob_minhash(doc, name, _weight(count), len(texts), bands * rows)
                keys = np.zeros((len(texts), bands), U)
                for j in range(rows):
                    keys = mix(keys * U(BASE) + signature[:, j::rows][:, :bands])
                keys += np.arange(bands, dtype=U) * U(0xD1B54A32D192ED03)
            some = np.zeros(len(texts), bool)
            some[doc] = True
            flat = pa.array(mix(keys[some]).ravel().view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(some * bands)])
            copy = [hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(copy, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "copy", "bands"])

    return run


def _sets(size: int):
    def run(batches):
        for batch, texts in _chunks(batches):
            with np.errstate(over="ignore"):
                doc, name, count = shingles(texts, size)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            blobs, flat = [], []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                flat.append(bool((count[i:j] == 1).all()))
                blobs.append(name[i:j].tobytes() + (b"" if flat[-1] else _weight(count[i:j]).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(blobs, pa.binary()), pa.array(np.diff(edge), pa.int64()), pa.array(flat, pa.bool_())], SET)

    return run


SET = ["doc_id", "set", "size", "flat"]


def _weight(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def _read(blob: pa.Buffer, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Names and weights; no weights where all are 1."""
    return np.frombuffer(blob, U, size), np.frombuffer(blob, np.float64, size, 8 * size) if blob.size > 8 * size else None


def probability_jaccard(x: np.ndarray, x_weight: np.ndarray | None, y: np.ndarray, y_weight: np.ndarray | None) -> float:
    """Of two weighted sets: the sum over shared names of 1 / sum of max(x' / x, y' / y) over all names."""
    if x_weight is None and y_weight is None:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    p, q = (np.ones(len(n)) if w is None else w for n, w in ((x, x_weight), (y, y_weight)))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(q[j] / p[i], kind="stable")
    a, b = p[i][order], q[j][order]
    # names with a smaller ratio y / x count by x, those with a larger one by y
    below, above = np.cumsum(a), b.sum() - np.cumsum(b)
    return float((1 / ((p.sum() - a.sum() + below) / a + (q.sum() - b.sum() + above) / b)).sum())


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            trim()
            keep, last, x = [], None, None
            for i, (a, n, b, m) in enumerate(zip(batch["set_a"], batch["size_a"].to_pylist(), batch["set_b"], batch["size_b"].to_pylist(), strict=True)):
                a = a.as_buffer()
                if last is None or not a.equals(last):
                    last, x = a, _read(a, n)
                y = _read(b.as_buffer(), m)
                if x[1] is None and y[1] is None and min(n, m) < similarity * max(n, m):
                    continue
                if probability_jaccard(*x, *y) >= similarity - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _shares(batches):
    """doc_id, part, name and share of the weight, a row for each shingle."""
    for batch in batches:
        trim()
        for i, (doc, part, blob, n) in enumerate(zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), batch["set"], batch["size"].to_pylist(), strict=True)):
            name, weight = _read(blob.as_buffer(), n)
            share = np.full(n, 1 / n) if weight is None else weight / weight.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, part)), pa.array(name.view(np.int64)), pa.array(share)], ["doc_id", "part", "name", "share"])


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """id, label of every id in links (a, b): the smallest id of its component.

    Labels travel along links and then to the label's own label, each step a pair of joins over
    a table in the shared folder; the number of steps grows with the logarithm of a component's width.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        fresh = materialize(step.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), name)
        moved = fresh.filter("old <> label").limit(1).count()
        labels = fresh.select("id", "label")
        if not moved:
            return labels


def _parts(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of buckets with the component of each; a document without a link is its own."""
    if labels is None:
        return shared.withColumn("part", F.col("doc_id"))
    return shared.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("label", "doc_id")).drop("label")


def _across(shared: DataFrame, labels: DataFrame | None, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs a, b of members of buckets with several components that lie in two and can reach the similarity.

    With u and v the shares of two documents' weights that lie on names which the other one lacks, the probability Jaccard
    is at most 1 / (1 + u / (1 - u) + v / (1 - v)): the sum over the shared names is that of a concave function of
    degree one.  Names that occur in one component only are shared by no pair.  The others of each document
    are taken from the rarest on; up to the first that a pair shares, u and v grow.  So a pair that reaches
    the similarity shares a name in the prefixes where its two odds u / (1 - u) still add up to 1 / similarity - 1 at most;
    of two sets without weights, where the fewer names that are left are enough for the similarity.
    Prefixes are joined by name; only members outside a name's largest component are paired with its other members.
    """
    rows = _parts(shared, labels)
    sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n"))
    several = materialize(sizes.groupBy("band").agg(F.count("*").alias("parts")).filter("parts > 1").select("band"), "open-bands")
    members = materialize(rows.join(several, "band").select("doc_id", "part").distinct(), "open-members")
    shares = members.join(sets, "doc_id").select("doc_id", "part", "set", "size").mapInArrow(_shares, "doc_id long, part long, name long, share double")
    shares = materialize(shares, "open-shingles")
    spread = shares.groupBy("name").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    spread = materialize(spread.filter("low <> high").select("name", "n"), "spread-shingles")
    most = 1 / similarity - 1 + 1e-9
    own = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("share").over(own.orderBy("n", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    held = shares.join(spread, "name").withColumn("left", F.sum("share").over(own) - before)
    prefixes = held.withColumn("odds", F.lit(1) / F.col("left") - 1).filter(F.col("odds") <= most).select("name", "doc_id", "part", "odds", "left")
    prefixes = prefixes.join(sets.select("doc_id", "size", "flat"), "doc_id").withColumn("left", F.col("left") * F.col("size"))
    prefixes = materialize(prefixes, "prefixes")
    parts = prefixes.groupBy("name", "part").agg(F.count("*").alias("n"))
    parts = parts.groupBy("name").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("rest"))
    # so many copies of a name's members as its smaller components need
    parts = materialize(parts.filter("parts > 1").select("name", "largest", F.ceil(F.col("rest") / MEMBERS).cast("int").alias("salts")), "prefix-names")
    rows = prefixes.join(parts, "name")
    names = ("doc_id", "part", "odds", "left", "size", "flat")
    one = rows.filter("part <> largest").select("name", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in names])
    two = rows.select("name", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "largest", *[F.col(c).alias(f"{c}_b") for c in names])
    counts = F.least("left_a", "left_b") >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    near = F.when(F.col("flat_a") & F.col("flat_b"), counts).otherwise(F.col("odds_a") + F.col("odds_b") <= most)
    once = (F.col("part_b") == F.col("largest")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    return one.join(two, ["name", "salt"]).filter((F.col("part_a") != F.col("part_b")) & once & near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id and class_id, the smallest doc_id of its class (null for a null doc_id)."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(own.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, copy binary, bands array<long>"), "signatures")
    some = signed.filter("doc_id is not null and size(bands) > 0")
    # tables between an aggregation and the join with it: so a hot key's rows can be dealt to several tasks
    copies = materialize(some.groupBy("copy").agg(F.min("doc_id").alias("rep")), "copies")
    member = materialize(some.select("doc_id", "copy").join(copies, "copy").select("doc_id", "rep"), "members")
    heads = some.join(copies.select(F.col("rep").alias("doc_id"), "copy"), ["doc_id", "copy"], "left_semi")
    keys = materialize(heads.groupBy("doc_id", "copy").agg(F.first("bands").alias("bands")).select("doc_id", F.explode("bands").alias("band")), "keys")
    full = materialize(keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "full-bands")
    shared = materialize(keys.join(full, "band"), "bands")
    degree = shared.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    shared = materialize(shared.select("doc_id", "band").join(degree, "doc_id"), "members-of-bands")
    wanted = shared.select("doc_id").distinct()
    # both sides by doc_id at every size: a broadcast of the ids would hold at small sizes only
    sets = own.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, set binary, size long, flat boolean")
    sets = materialize(sets.groupBy("doc_id").agg(F.min(F.struct("set", "size", "flat")).alias("s")).select("doc_id", "s.*"), "sets")

    links, labels, tried = None, None, None
    for k in range(rounds + 1):
        if k == rounds:  # what the rounds left out
            pairs = _across(shared, labels, sets, similarity)
        elif labels is None:
            rows_k = shared.withColumn("part", F.col("doc_id"))
            best = F.max_by("doc_id", F.struct("degree", -F.col("doc_id")))
            centre = materialize(rows_k.groupBy("band").agg(best.alias("a")), "centres")
            pairs = rows_k.join(centre, "band").select("a", F.col("doc_id").alias("b"))
        else:
            rows_k = _parts(shared, labels)
            order = F.struct(F.xxhash64(F.col("doc_id"), F.lit(k)), "doc_id")
            heads_k = rows_k.groupBy("band", "part").agg(F.max_by("doc_id", order).alias("b"), F.count("*").alias("n"))
            top = F.struct("n", "b")
            centre = materialize(heads_k.groupBy("band").agg(F.max_by("b", top).alias("a"), F.max_by("part", top).alias("centre"), F.count("*").alias("parts")).filter("parts > 1"), "centres")
            # every member of the smaller parts against the centre of the largest
            pairs = rows_k.join(centre, "band").filter("part <> centre").select("a", F.col("doc_id").alias("b"))
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").groupBy("x", "y").agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        copies_of = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "centre-copies")
        salted = pairs.join(copies_of, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
        left = copies_of.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"), F.col("size").alias("size_a")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "set_a", "size_a")
        right = salted.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"), F.col("size").alias("size_b")), "b")
        found = materialize(right.join(left, ["a", "salt"]).select("a", "b", "set_a", "size_a", "set_b", "size_b").mapInArrow(_verify(similarity), "a long, b long"), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is not None and not found.limit(1).count():
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    reps = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))
    return signed.select("doc_id").join(reps, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its class, five words and 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark, docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their class; nulls in doc_id stay."""
    out = materialize(near_duplicates(docs).filter("class_id < doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(out, "doc_id", "left_anti")
