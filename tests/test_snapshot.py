"""Lists of posts, pictures and other rules over snapshots."""

from pyspark.sql import functions as F

from quire.functions.url import INDEX_PATHS
from quire.operators import snapshot

POSTS = "".join(f'<li><a href="https://e.org/post-{i}#x">A post title {i}</a> with a blurb of words</li>' for i in range(6))


def test_list_pages(spark):
    page = f"<p>Start here</p><ul>{POSTS}<li>About</li></ul>"
    want = [f"https://e.org/post-{i}#x" for i in range(6)]
    assert snapshot.list_targets(page, "https://www.e.org/start", INDEX_PATHS) == want
    essay = "<p>" + "Long prose. " * 80 + "</p>" + f"<ul>{POSTS}</ul>"
    assert snapshot.list_targets(essay, "https://e.org/a", INDEX_PATHS) == []
    assert snapshot.list_targets(page, "https://other.org/", INDEX_PATHS) == [] == snapshot.list_targets(None, "", INDEX_PATHS)
    rows = spark.createDataFrame([("https://e.org/start", page), ("https://e.org/a", essay)], "url string, html string")
    assert [r.target for r in snapshot.list_pages(rows, most=2).orderBy("pos").collect()] == want[:2]


def test_other_addresses(spark):
    urls = ["https://medium.com/@ann/a-story-0123456789ab", "https://ann.medium.com/b-story-abcdef12", "https://medium.com/p/x", "https://e.org/a", "https://www.lesswrong.com/posts/1?a=b"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(snapshot.story_feed(F.col("u")).alias("s"), snapshot.mirror(F.col("u")).alias("m")).collect()
    assert [(r.s.feed, r.s.story) for r in got] == [("https://medium.com/feed/@ann", "0123456789ab"), ("https://ann.medium.com/feed", "abcdef12"), (None, None), (None, None), (None, None)]
    assert [r.m for r in got] == [None] * 4 + ["https://www.greaterwrong.com/posts/1?a=b"]


def test_pictures(spark):
    html = '<p>a<img src="u1"> b <img src="u2"></p><figure><img src="gone"><figcaption>c</figcaption></figure><figure><blockquote>q</blockquote><img src="gone"></figure>'
    chapters = spark.createDataFrame([("b", 0, html), ("b", 1, "<p>none</p>"), ("b", 2, None)], "book_id string, pos long, html string")
    shots = spark.createDataFrame([("u1", "image/png", bytearray(b"x")), ("u2", "image/png", bytearray(b"x")), ("gone", None, None), ("unused", "image/gif", bytearray(b"y"))], "url string, media_type string, data binary")
    out, assets = snapshot.apply_images(chapters, shots)
    got = {r.pos: r.html for r in out.collect()}
    (asset,) = assets.collect()
    assert asset.name.startswith("images/img-") and asset.name.endswith(".png") and got[0].count(asset.name) == 2
    assert "figcaption" not in got[0] and "<blockquote>q</blockquote>" in got[0] and got[1] == "<p>none</p>"
    bare, none = snapshot.apply_images(chapters, shots, "strip")
    assert not any("<img" in (r.html or "") for r in bare.collect()) and none.count() == 0
    assert snapshot.apply_images(chapters, shots, "link")[0].collect() == chapters.collect()


def test_lettrine():
    assert snapshot.lettrine("<p>Once upon</p>") == '<p><span class="lettrine">O</span><span class="lettrine-run">nce</span> upon</p>'
    assert snapshot.lettrine("<p><b>x</b></p>") == "<p><b>x</b></p>" and snapshot.lettrine("<p>A man</p>") == "<p>A man</p>" and snapshot.lettrine(None) == ""
