"""Scalar rules that need Unicode tables or name lists, as Arrow functions over columns."""

from __future__ import annotations

import base64
import codecs
import re
import unicodedata
from urllib.parse import quote, unquote_to_bytes

from quire.functions.tree import fold
from quire.operators.article import parse_date

# Words that tell an organisation's name.
ORGANISATION = frozenset(
    "news staff team editors editorial editor admin contributors media press magazine journal review times post daily weekly tribune herald gazette center centre institute foundation association society project group company university college school department office bureau agency committee council board network service services studio studios lab labs inc llc ltd corp co gmbh".split()
)


def slugify(text: str | None, fallback: str = "book") -> str:
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60] or fallback


def inverted(name: str) -> str:
    """Jane Q. Doe: Doe, J. Q.  Small particles stay with the surname; what doesn't read like a person's name stays."""
    words = name.split()
    person = len(words) in (2, 3) and not words[0].islower() and not re.search(r"\d", name)
    if not person or ORGANISATION & {w.strip(".,").lower() for w in words}:
        return name
    cut = len(words) - 1
    while cut > 1 and words[cut - 1].islower():
        cut -= 1
    given = ["-".join(f"{p[0].upper()}." for p in w.split("-") if p) for w in words[:cut]]
    return f"{' '.join(words[cut:])}, {' '.join(given)}"


def byline(raw: str | None) -> str | None:
    """Several authors as in a reference list; a name that is inverted already stays as it is."""
    text = fold(re.sub(r"^by\s+", "", raw or "", flags=re.I))
    people: list[str] = []
    for part in re.split(r"\s*(?:;|&|\band\b)\s*", text, flags=re.I):
        names = [n.strip() for n in part.split(",") if n.strip()]
        if len(names) > 1 and any(" " not in n for n in names):
            return text
        people += map(inverted, names)
    if not people:
        return None
    return people[0] if len(people) == 1 else f"{', '.join(people[:-1])}, & {people[-1]}"


def decode_body(data: bytes | None, content_type: str | None = "") -> str | None:
    """By the header's charset, then the page's own, then UTF-8, then Latin-1; Latin-1 and ASCII labels mean cp1252."""
    if data is None:
        return None
    named = re.search(r"charset=[\"']?([\w.:-]+)", content_type or "", re.I)
    own = re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", data[:4096], re.I)
    for label in (named and named[1], own and own[1].decode("ascii"), "utf-8"):
        try:
            name = codecs.lookup(label).name if label else None
            if name:
                return data.decode("cp1252" if name in ("iso8859-1", "ascii") else name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def decode_data_uri(uri: str | None) -> tuple[bytes, str] | None:
    head, mark, body = (uri or "").partition(",")
    if not head.lower().startswith("data:") or not mark:
        return None
    kind = head[5:].split(";")[0] or "text/plain"
    try:
        raw = unquote_to_bytes(body)
        return (base64.b64decode(raw, validate=False) if head.lower().endswith(";base64") else raw), kind
    except ValueError:
        return None


def requote(url: str) -> str:
    """Raw characters percent-encoded, escapes that are there kept."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of PNG, GIF and JPEG data by their heads."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def iso_date(value: str | None) -> str | None:
    when = parse_date(value)
    return when.isoformat() if when else None


def casefold(text: str | None) -> str | None:
    return None if text is None else text.casefold()
