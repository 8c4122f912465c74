"""Running sums in two levels against sums over whole groups."""

import random

from pyspark.sql import functions as F

from quire.operators import numbering, scan


def test_groups_of_all_sizes(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + [None, "a", "b", "c"]), i, r.choice([None, -2, 1, 3])) for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "site string, pos long, n long").repartition(7)
    want, sums = {}, {}
    for site, pos, n in sorted(rows, key=lambda x: x[1]):
        sums[site] = sums.get(site, 0) + (n or 0)
        want[site, pos] = sums[site]
    got = scan.running(df, ["site"], ["pos"], total=F.col("n"))
    assert {(x.site, x.pos): x.total for x in got.collect()} == want and got.count() == len(rows)
    before = scan.running(df, ["site"], ["pos"], exclusive=True, total=F.col("n"), one=F.lit(1))
    seen = {}
    for x in sorted(before.collect(), key=lambda x: x.pos):
        assert x.total == want[x.site, x.pos] - (x.n or 0) and x.one == seen.get(x.site, 0)
        seen[x.site] = x.one + 1


def test_one_site_of_a_million_links_uses_many_tasks(spark):
    links = spark.range(10**6).select(F.lit("site").alias("host"), (F.col("id") * 7919 % 10**6).alias("pos"))
    out = numbering.link_numbers(links, "host", ["pos"])
    assert out.filter("number <> pos + 1").count() == 0 and out.count() == 10**6
    sizes = [x["count"] for x in scan.dealt(links, ["host"], ["pos"], one=F.lit(1)).groupBy(scan.BLOCK).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 10**6 / 4


def test_several_keys_ties_and_nothing(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "book string, part long, pos long")
    got = sorted(tuple(x) for x in scan.numbered(df, ["book", "part"], ["pos"]).collect())
    assert got == [("a", 1, 5, 1), ("a", 1, 5, 2), ("a", 2, 5, 1), ("b", 1, 1, 1)]
    assert scan.numbered(df.limit(0), ["book"], ["pos"]).collect() == []


def test_typed_figures(spark):
    titles = ["1. One", " IV.  Four", "12345. No", "A. No", "3.No", "3. ", "3", None, "MCMXCIX. Year", "1.5. Half", "x 1. No", "XIIIIIIII. No"]
    figure, rest = numbering.typed_figure(F.col("t"))
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(figure.alias("f"), rest.alias("r")).collect()
    assert [tuple(x) for x in got] == [("1", "One"), ("IV", "Four"), *[(None, None)] * 6, ("MCMXCIX", "Year"), *[(None, None)] * 3]
