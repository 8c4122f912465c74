"""License scans by MinHash bands over overlapping windows, in DataFrame operations only.

Texts and templates are lower-case words (letters and digits); a shingle is five words, or all
words of a template that has fewer.  A template of n words is looked for in windows of n + s - 1
words at every s-th word (s = max(1, n // 4)), so that each occurrence lies whole in a window.
Every window gets ``BANDS`` min-hashes of one row each: a window that holds 0.8 of a template's
shingles has a Jaccard similarity of at least ``low`` with it (``least_similarity``) and meets
it in some band with probability 1 - (1 - low) ** BANDS, above 0.999.  Windows that meet a template are
verified by exact containment of its shingles.

Before that, texts without any *trigger* word are passed over.  Triggers are chosen from the
templates so that the shingles without one are too few for a match; the filter loses nothing.
A window can meet a template in band k only if it holds the template's least shingle under hash k, so the
windows that hold one of these shingles are hashed and no others: what the bands retrieve is the same.

Null and empty texts match nothing.  Rows with the same doc_id count as one document; repeated
templates are reported under their own ids.  Other columns are not read.  The templates are a
driver-side list; each pass takes ``PASS_TEMPLATES`` of them, whose signatures are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS, PASS_TEMPLATES = 5, 0.8, 16, 500
# Wordings by which licenses are named, and the openings of some license texts.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(words: list[str], size: int) -> list[str]:
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})


def stride(n: int) -> int:
    return max(1, n // 4)


def least_similarity(n: int, size: int = SHINGLE, containment: float = CONTAINMENT) -> float:
    """Of a window that just reaches the containment, with a template of n words."""
    own = max(1, n - size + 1)
    there = max(1, n + stride(n) - 1 - size + 1)
    held = -(-int(containment * own * 1000) // 1000)
    return held / (own + there - held)


def triggers(templates: dict[str, str], size: int = SHINGLE, containment: float = CONTAINMENT) -> list[str]:
    """Words of which every match of every template has one."""
    out: list[str] = []
    every = [template_shingles(template_words(t), size) for t in templates.values()]
    for shingles in sorted(every, key=len):
        while True:
            free = [set(s.split()) for s in shingles if not set(s.split()) & set(out)]
            if len(free) < containment * len(shingles):
                break
            words = sorted({w for s in free for w in s})
            out.append(max(words, key=lambda w: (sum(w in s for s in free) * min(len(w), 8) ** 2, len(w), w)))
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))


def _mixed(shingles, k: int) -> Column:
    """The k-th hash of each shingle."""
    return F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k)))


def _once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """A column that is computed once for each row: the optimizer doesn't copy it into what reads it."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def _starts(hits: Column, wide: int, step: int) -> Column:
    """Windows (every step-th, so wide) that hold one of the hits."""
    first = lambda p: (F.greatest(F.lit(0), F.ceil((p - wide + 1) / step)) * step).cast("int")
    return F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(first(p), (F.floor(p / step) * step).cast("int"), F.lit(step)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, license_id, containment (of the best window), first_word (of the first that matches) and windows (that match)."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    by_size: dict[int, list[tuple[str, list[str]]]] = {}
    for name, t in sorted(templates.items()):
        words = template_words(t)
        if words:
            by_size.setdefault(min(len(words), size), []).append((name, words))
    blocks = [(k, own[i : i + PASS_TEMPLATES]) for k, own in sorted(by_size.items()) for i in range(0, len(own), PASS_TEMPLATES)]
    parts = [_scan(docs, own, doc_id, text, k, containment, bands, {n: templates[n] for n, _ in own}) for k, own in blocks]
    if not parts:
        return spark.createDataFrame([], "doc_id long, license_id string, containment double, first_word long, windows long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scan(docs, own, doc_id, text, size, containment, bands, templates) -> DataFrame:
    spark = docs.sparkSession
    rows = [(name, len(words), template_shingles(words, size)) for name, words in own]
    theirs = spark.createDataFrame(rows, "license_id string, n int, shingles array<string>")
    theirs = theirs.select("license_id", "n", F.transform("shingles", lambda s: F.xxhash64(s)).alias("theirs"))
    signed = theirs.select("license_id", "n", "theirs", F.posexplode(F.array(*[F.array_min(_mixed("theirs", k)) for k in range(bands)])).alias("band", "least"))
    classes = sorted({n for _, n, _ in rows})

    low = F.lower(F.col(text))
    some = F.lit(False)
    for w in triggers(templates, size, containment):
        some = some | low.contains(w)
    base = _once(docs.filter(some).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "words", _words(F.col("text"))).select("doc_id", "words")
    base = _once(base, "sh", _shingles(F.col("words"), size)).select("doc_id", "sh")
    least = F.array(*[F.array_min(F.transform("theirs", lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), x.alias("x"))))["x"] for k in range(bands)])  # noqa: B023
    known = sorted({x for r in theirs.select(least.alias("x")).collect() for x in r[0]})
    at = F.when(F.size("sh") > 0, F.sequence(F.lit(0), F.size("sh") - 1)).otherwise(F.array().cast("array<int>"))
    base = _once(base, "hits", F.filter(at, lambda i: F.get("sh", i).isin(known))).filter(F.size("hits") > 0)

    def windows(n: int) -> Column:
        wide, step = max(1, n + stride(n) - size), stride(n)
        return F.transform(_starts(F.col("hits"), wide, step), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.slice("sh", i + 1, wide).alias("held")))

    each = base.select("doc_id", F.explode(F.flatten(F.array(*[windows(n) for n in classes]))).alias("w")).select("doc_id", "w.*")
    each = _once(each, "least", F.array(*[F.array_min(_mixed("held", k)) for k in range(bands)]))
    met = each.select("doc_id", "n", "at", "held", F.posexplode("least").alias("band", "least")).join(F.broadcast(signed), ["n", "band", "least"])
    share = F.size(F.array_intersect("held", "theirs")) / F.size("theirs")
    found = met.select("doc_id", "license_id", "at", share.alias("containment")).filter(F.col("containment") >= containment)
    found = found.groupBy("doc_id", "license_id", "at").agg(F.max("containment").alias("containment"))
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("windows"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document against the built-in templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("containment", F.round("containment", 6))


def op9_sql() -> str:
    """The same windows, all compared with all templates."""
    rows = ", ".join("('{}', {}, [{}])".format(name, len(w), ", ".join(f"'{s}'" for s in template_shingles(w, min(SHINGLE, len(w))))) for name, w in ((n, template_words(t)) for n, t in sorted(TEMPLATES.items())))
    return f"""
WITH t(license_id, n, sh) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - {SHINGLE - 1})) AS i, w FROM w WHERE len(w) >= {SHINGLE}),
h AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS sh FROM s),
ts AS (SELECT license_id, n, greatest(1, n // 4) AS step, len(sh) AS total, unnest(sh) AS sh FROM t),
hit AS (SELECT h.doc_id, h.i, h.sh, ts.license_id, ts.step, ts.total, greatest(1, ts.n + ts.step - {SHINGLE}) AS wide FROM h JOIN ts ON h.sh = ts.sh),
win AS (SELECT doc_id, license_id, total, sh, unnest(range(greatest(0, -((wide - 1 - i) // step)) * step, i + 1, step)) AS pos, i, wide FROM hit),
c AS (SELECT doc_id, license_id, pos, count(DISTINCT sh) / max(total) AS share FROM win WHERE pos <= i AND i < pos + wide GROUP BY 1, 2, 3)
SELECT doc_id, license_id, round(max(share), 6) AS containment, CAST(min(pos) AS BIGINT) AS first_word, CAST(count(*) AS BIGINT) AS windows
FROM c WHERE share >= {CONTAINMENT} GROUP BY 1, 2
"""
