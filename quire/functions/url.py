"""URL functions as Column expressions.  They parse by pattern, so a broken URL gives "" and not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import folded

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
# Paths that list posts.
INDEX_PATHS = ("", "blog", "posts", "articles", "news", "writing", "essays", "journal", "archive", "archives", "home", "latest", "index.html", "index.htm")
# Query parameters that only track.
TRACKING = ("utm_", "source=", "ref=", "mc_cid=", "mc_eid=")


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, f"(?:{SCHEME})?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, f"^(?:{SCHEME.lstrip('^')})?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def _digits(delta: Column, bias: Column) -> Column:
    """A number as letters and digits of base 36, the least first; each place's threshold tells where the number ends."""

    def place(s, k):
        t = F.least(F.greatest(k - s["bias"], F.lit(1)), F.lit(26)).cast("long")
        last = s["left"] < t
        digit = F.when(last, s["left"]).otherwise(t + (s["left"] - t) % (36 - t))
        left = F.when(last, F.lit(-1)).otherwise(_div(s["left"] - t, 36 - t)).cast("long")
        said = F.concat(s["out"], F.substr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (digit + 1).cast("int"), F.lit(1)))
        return F.when(s["left"] < 0, s).otherwise(F.struct(left.alias("left"), s["bias"].alias("bias"), said.alias("out")))

    places = F.array(*[F.lit(36 * i).cast("long") for i in range(1, 13)])
    return F.aggregate(places, F.struct(delta.alias("left"), bias.alias("bias"), F.lit("").alias("out")), place, lambda s: s["out"])


def _bias(delta: Column, count: Column, first: Column) -> Column:
    """The thresholds' shift after a number, from its size and how many letters are placed."""
    d = _div(delta, F.when(first, 700).otherwise(2))
    start = F.struct((d + _div(d, count)).alias("d"), F.lit(0).cast("long").alias("k"))
    step = lambda s, _: F.when(s["d"] > 455, F.struct(_div(s["d"], 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda s: s["k"] + _div(36 * s["d"], s["d"] + 38))


def bootstring(label: Column) -> Column:
    """A label of a host name with letters beyond ASCII as ASCII (RFC 3492); other labels stay.

    One fold over the distinct letters beyond ASCII in their order, and for each of them one over the label.
    """
    code = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))
    plain = F.regexp_replace(label, "[^\\x00-\\x7F]+", "")
    basic = F.length(plain).cast("long")

    def state(n, delta, bias, placed, out):
        return F.struct(n.cast("long").alias("n"), delta.cast("long").alias("delta"), bias.cast("long").alias("bias"), placed.cast("long").alias("placed"), out.alias("out"))

    def letter(s, m):
        def place(t, c):
            put = state(t["n"], F.lit(0), _bias(t["delta"], t["placed"] + 1, t["placed"] == basic), t["placed"] + 1, F.concat(t["out"], _digits(t["delta"], t["bias"])))
            skip = state(t["n"], t["delta"] + (c < m).cast("long"), t["bias"], t["placed"], t["out"])
            return F.when(c == m, put).otherwise(skip)

        ahead = state(m, s["delta"] + (m - s["n"]) * (s["placed"] + 1), s["bias"], s["placed"], s["out"])
        return F.aggregate(code, ahead, place, lambda t: state(m + 1, t["delta"] + 1, t["bias"], t["placed"], t["out"]))

    beyond = F.array_sort(F.array_distinct(F.filter(code, lambda c: c > 127)))
    coded = F.aggregate(beyond, state(F.lit(128), F.lit(0), F.lit(72), basic, F.lit("")), letter, lambda s: s["out"])
    return F.when(label.rlike("[^\\x00-\\x7F]"), F.concat(F.lit("xn--"), plain, F.when(basic > 0, "-").otherwise(""), coded)).otherwise(label)


def ascii_host(host: Column) -> Column:
    """An international host name as its ASCII name; other hosts stay, and so do names with a label that is empty or beyond 63.

    Letters are case-folded.  Spark has no Unicode normalisation, so letters with separate accents and wide forms are coded as written;
    names that mix directions of writing are coded too.
    """
    labels = F.transform(F.split(folded(host), "[.\u3002\uff0e\uff61]"), bootstring)
    good = F.forall(labels, lambda x: F.length(x).between(1, 63)) | F.forall(F.slice(labels, 1, F.size(labels) - 1), lambda x: F.length(x).between(1, 63)) & (F.element_at(labels, -1) == "")
    return F.when(host.rlike("[^\\x00-\\x7F]"), F.when(good, F.array_join(labels, ".")).otherwise(host)).otherwise(host)


def host_key(url: Column) -> Column:
    """Lower-case host without user, port and www, as written: see ``site_key`` for international names."""
    host = F.lower(F.regexp_extract(netloc(url), "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1))
    return F.regexp_replace(host, "^www\\.", "")


def site_key(url: Column) -> Column:
    """``host_key`` with an international name in ASCII, so that both spellings are one host.

    The fold is a large expression that Spark plans for about a second; plans over hosts known to be ASCII use ``host_key``.
    """
    return ascii_host(host_key(url))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, f"({SCHEME}//[^/?#]*)", 1)


def item_key(url: Column) -> Column:
    """What identifies a post: host, path without its last slashes, query without tracking, sorted."""
    p = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    keep = F.filter(F.split(query(url), "&"), lambda q: (q != "") & ~sum((q.startswith(t).cast("int") for t in TRACKING), F.lit(0)).cast("boolean"))
    return F.concat_ws(" ", F.lower(netloc(url)), F.when(p == "", "/").otherwise(p), F.array_join(F.array_sort(keep), "&"))


def is_index(url: Column) -> Column:
    """No query, and a path that lists posts."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url))
    return (query(url) == "") & F.lower(F.regexp_replace(decoded, "^/+|/+$", "")).isin(*INDEX_PATHS)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other; never for an empty host."""
    dot = F.lit(".")
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(dot, b)) | b.endswith(F.concat(dot, a)))


def suffixes(host: Column) -> Column:
    """The host and every domain above it: the keys of an equi-join that finds subdomains."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def absolute(base: Column, href: Column) -> Column:
    """Resolves hrefs with a scheme, from the root, or with a host; others stay."""
    return F.when(href.rlike(SCHEME), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, f"({SCHEME})", 1), href)).when(href.startswith("/"), F.concat(origin(base), href)).otherwise(href)


# Address ranges that are private, local or reserved, as patterns of the written address.
PRIVATE = "^(?:0|10|127)\\.|^169\\.254\\.|^192\\.168\\.|^172\\.(?:1[6-9]|2[0-9]|3[01])\\.|^100\\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.|^(?:22[4-9]|2[3-5][0-9])\\.|^\\[(?:::1?\\]|f[cdef])"
LOCAL = "^localhost$|\\.localhost$|\\.local$|\\.internal$"


def is_public(url: Column) -> Column:
    """A web address whose host, as written, is neither local nor in a private range.  Names are not resolved here."""
    host = host_key(url)
    return F.coalesce(F.lower(url).rlike("^https?://") & (host != "") & ~host.rlike(PRIVATE) & ~host.rlike(LOCAL), F.lit(False))
