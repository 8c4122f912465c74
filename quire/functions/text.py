"""Text functions as Column expressions; they stay in the JVM.

White space is Python's: the Unicode class and U+001C to U+001F, but not U+200B.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)[\\s\\x1c-\\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(html: Column) -> Column:
    """Words of a fragment: tags count as spaces."""
    return F.size(words(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))).cast("long")


def escape_html(c: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The named references that the tables hold, the ampersand last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_named(c: Column) -> Column:
    for a, b in NAMED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_xml(c: Column) -> Column:
    """Escaped, without the characters that XML 1.0 forbids."""
    return escape_html(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", ""), quote=True)


def paragraphs(text: Column) -> Column:
    """Blank lines part paragraphs; a line break inside one becomes a space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n")
    blocks = F.transform(F.split(t, f"\\n{WS}*\\n+"), strip)
    return F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.regexp_replace(b, f"{WS}*\\n{WS}*", " "))


def text_to_html(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "\n")


def prettify(name: Column) -> Column:
    """my-first_post: My First Post.  Only first letters change."""
    parts = words(F.regexp_replace(name, "[-_]+", " "))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def terminal_period(c: Column) -> Column:
    return F.when(c.rlike("[.?!…]$"), c).otherwise(F.concat(c, F.lit(".")))


def link_label(number: Column, marker: str = "letter") -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("]")) if marker == "bracket" else F.concat(F.lit("L"), number.cast("string"))


def number_value(figure: Column) -> Column:
    """The value of an arabic or roman figure; roman ones are read without validation."""
    value = lambda ch: sum((F.when(ch == r, n).otherwise(0) for r, n in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))), F.lit(0))
    digits = F.transform(F.filter(F.split(figure, ""), lambda ch: ch != ""), value)
    at = F.sequence(F.lit(0), F.greatest(F.size(digits) - 1, F.lit(0)))
    roman = F.aggregate(at, F.lit(0), lambda t, i: t + F.when(F.coalesce(F.get(digits, i + 1), F.lit(0)) > F.get(digits, i), -F.get(digits, i)).otherwise(F.get(digits, i)))
    return F.when(figure.rlike("^[0-9]+$"), figure.try_cast("long")).otherwise(roman.cast("long"))


def format_number(value: Column) -> Column:
    """At most two decimals, no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), "0+$", ""), "\\.$", "")


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that fold to one letter, and those that fold to several, by Unicode's full case folding."""
    every = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000}
    every = {a: b for a, b in every.items() if a != b}
    return {a: b for a, b in every.items() if len(b) == 1}, {a: b for a, b in every.items() if len(b) > 1}


def folded(text: Column) -> Column:
    """Full case folding, as str.casefold: keys that compare and sort without regard to case.  Null stays null.

    Letters that fold to several are looked up one by one, only in texts that hold some.
    """
    one, many = _folds()
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    whole = F.when(text.rlike("[" + "".join(many) + "]"), spelt).otherwise(text)
    return F.translate(whole, "".join(one), "".join(one.values()))
