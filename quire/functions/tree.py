"""Markup as a table of nodes in document order.

A fragment is parallel lists: tag ("" for text), attributes, text, parent and the end of each
subtree.  Nothing is moved: a step marks nodes as dropped (with their subtree) or unwrapped,
renames them, or puts markup before or after them; ``html`` writes what the marks leave.  So a chain of
steps is one parse, some passes over lists, and one write.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without content, elements that part words, and what an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SPACE = re.compile(r"\s+")


def fold(text: str) -> str:
    return SPACE.sub(" ", text or "").strip()


class _Reader(HTMLParser):
    def __init__(self, into: Fragment):
        super().__init__(convert_charrefs=True)
        self.f, self.open = into, [0]

    def _node(self, tag: str, attrs: dict, text: str) -> int:
        f = self.f
        f.tag.append(tag), f.attrs.append(attrs), f.text.append(text), f.up.append(self.open[-1]), f.stop.append(0)
        return len(f.tag) - 1

    def _close(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.f.stop[i] = len(self.f.tag)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag) or (("p",) if tag in BLOCK else ())
        while len(self.open) > 1 and self.f.tag[self.open[-1]] in ended:
            self._close(len(self.open) - 1)
        i = self._node(tag, dict(attrs), "")
        if tag in VOID:
            self.f.stop[i] = i + 1
        else:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        i = self._node(tag, dict(attrs), "")
        self.f.stop[i] = i + 1

    def handle_endtag(self, tag):
        at = next((d for d in range(len(self.open) - 1, 0, -1) if self.f.tag[self.open[d]] == tag), 0)
        if at and tag not in VOID:
            self._close(at)

    def handle_data(self, data):
        if data:
            i = self._node("", {}, data)
            self.f.stop[i] = i + 1


class Fragment:
    def __init__(self, markup: str | None):
        self.tag, self.attrs, self.text, self.up, self.stop = ["#root"], [{}], [""], [-1], [0]
        reader = _Reader(self)
        reader.feed(markup or "")
        reader.close()
        reader._close(0)
        n = len(self.tag)
        self.gone, self.flat = bytearray(n), bytearray(n)
        self.before: dict[int, str] = {}
        self.after: dict[int, str] = {}

    def drop(self, i: int) -> None:
        self.gone[i : self.stop[i]] = b"\1" * (self.stop[i] - i)

    def unwrap(self, i: int) -> None:
        self.flat[i] = 1

    def live(self, root: int = 0) -> Iterator[int]:
        """Nodes of a subtree that are left, in document order; marks set meanwhile count."""
        for i in range(root, self.stop[root]):
            if not self.gone[i]:
                yield i

    def find(self, *tags: str, root: int = 0) -> list[int]:
        return [i for i in self.live(root) if self.tag[i] in tags and not self.flat[i] and i != root]

    def parents(self, i: int) -> Iterator[int]:
        i = self.up[i]
        while i >= 0:
            yield i
            i = self.up[i]

    def children(self, i: int) -> list[int]:
        """Children that are left, seen through unwrapped ones."""
        out, k = [], i + 1
        while k < self.stop[i]:
            if self.gone[k]:
                k = self.stop[k]
            elif self.flat[k]:
                k += 1
            else:
                out.append(k)
                k = self.stop[k]
        return out

    def words(self, root: int = 0, skip: Callable[[int], bool] | None = None) -> str:
        """Text of a subtree with a space behind each block and line break."""
        out, ends, k, stop = [], [], root, self.stop[root]
        while k < stop:
            while ends and ends[-1] <= k:
                ends.pop()
                out.append(" ")
            if self.gone[k] or skip and skip(k):
                k = self.stop[k]
                continue
            if not self.tag[k]:
                out.append(self.text[k])
            elif self.tag[k] == "br":
                out.append(" ")
            elif self.tag[k] in BLOCK and not self.flat[k]:
                ends.append(self.stop[k])
            k += 1
        return "".join(out) + " " * len(ends)

    def line(self, root: int = 0) -> str:
        return fold(self.words(root))

    def names(self, i: int) -> str:
        return f"{self.attrs[i].get('id') or ''} {self.attrs[i].get('class') or ''}".lower()

    def link_share(self, root: int) -> float:
        whole = len(self.words(root))
        return min(1.0, sum(len(self.words(a)) for a in self.find("a", root=root)) / whole) if whole else 0.0

    def html(self, root: int = 0, own: bool = False) -> str:
        """What is inside the root, or the root too."""
        out, ends, k, stop = [], [], root if own else root + 1, self.stop[root]
        while True:
            while ends and ends[-1][0] <= k:
                out.append(ends.pop()[1])
            if k >= stop:
                return "".join(out)
            if self.gone[k]:
                out.append(self.before.get(k, "") + self.after.get(k, ""))
                k = self.stop[k]
                continue
            out.append(self.before.get(k, ""))
            tail = self.after.get(k, "")
            tag = self.tag[k]
            if not tag:
                raw = self.tag[self.up[k]] in ("script", "style")
                out.append((self.text[k] if raw else entities.escape(self.text[k], quote=False)) + tail)
            elif self.flat[k]:
                if tail:
                    ends.append((self.stop[k], tail))
            else:
                attrs = "".join(f' {a}="{entities.escape(v or "", quote=True)}"' for a, v in self.attrs[k].items())
                if tag in VOID:
                    out.append(f"<{tag}{attrs} />{tail}")
                else:
                    out.append(f"<{tag}{attrs}>")
                    ends.append((self.stop[k], f"</{tag}>{tail}"))
            k += 1


def well_formed(markup: str | None) -> str:
    return Fragment(markup).html()


def parsed(markup: Fragment | str | None) -> Fragment:
    """Markup as a fragment; one that is parsed already stays as it is, so that several readers share a parse."""
    return markup if isinstance(markup, Fragment) else Fragment(markup)


def visible_length(markup: Fragment | str | None) -> int:
    f = parsed(markup)
    return len(fold(f.words(skip=lambda k: f.tag[k] in ("script", "style"))))


def has_image(markup: Fragment | str | None) -> bool:
    f = parsed(markup)
    return any(f.attrs[i].get("width") != "1" and f.attrs[i].get("height") != "1" for i in f.find("img"))
