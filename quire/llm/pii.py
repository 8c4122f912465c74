"""Personal data: pattern spans, and spans of a linear-chain conditional random field.

The patterns find email, ip, card and phone, leftmost and without overlap by kind, in code
points.  The field labels the words of each line (O or a kind) from word shapes: kinds of
characters, first character, length and a few context words, of the word and its neighbours.  It
is trained here, from a small labelled table, by gradient ascent on the log likelihood, and decoded by
Viterbi for a batch of lines at once.  Its spans of the kinds in ADDED are added where they touch no pattern
span: secrets and keys, phones without a plus, names behind a title or "my name is", street addresses and
account numbers.  Emails, addresses of machines and cards are what their patterns and checks accept, no more.
Null and empty texts have no spans; equal texts have equal spans.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blobs import trim
from quire.llm.words import Words
from quire.runtime import ship

KINDS = ("email", "ip", "card", "phone")
ADDED = ("phone", "secret", "name", "address", "account")
#: A name has up to two words; an address is a number, up to two words and the last one: each place has its own label.
LABELS = ("O", *KINDS, *ADDED[1:], "name+1", "address+1", "address+2", "address+9")
BASE = [x.split("+")[0] for x in LABELS]
KEPT = np.array([x in ADDED for x in BASE])
NEXT = {"address": ("address+1", "address+9"), "address+1": ("address+2", "address+9"), "address+2": ("address+9",)}
PREVIOUS = {"name+1": ("name",), "address+1": ("address",), "address+2": ("address+1",), "address+9": ("address", "address+1", "address+2")}
FORBIDDEN = np.array([[-1e4 * (b not in NEXT.get(a, (b,)) or a not in PREVIOUS.get(b, (a,))) for b in LABELS] for a in LABELS])
NO_START = np.array([-1e4 * (x in PREVIOUS) for x in LABELS])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


# The labelled table: sentences whose {kind} places a seeded generator fills; what follows a low line tells the form.
SENTENCES = (
    "please write to {email} before friday",
    "contact: {email} or {email}",
    "mail {email}, phone {phone}.",
    "call {phone} for details",
    "tel. {phone} fax {phone}",
    "call {phone_plain} for details",
    "Call us at {phone_plain} or come by",
    "tel. {phone_plain} fax {phone_plain}",
    "phone: {phone_plain}, ask for the chief",
    "tel: {phone_plain} (home)",
    "Phone: {phone_plain} - weekdays",
    "tel. {phone_plain} (home) or {phone_plain} (work)",
    "Fax: {phone_plain}",
    "it was signed by tel {phone_plain}",
    "please phone {phone_plain} or fax {phone_plain} today",
    "our tel {phone_plain} and fax: {phone_plain}.",
    "the phone number is {phone_plain} in the evening",
    "the server at {ip} did not answer",
    "login from {ip} was refused by {ip}.",
    "paid with card {card} on monday",
    "card number {card}, thank you",
    'token = "{secret}"',
    'set token = "{secret}" in the file',
    "api_key = {secret}",
    'password = "{secret}" and more text',
    "secret: {secret} is old",
    'key = "{secret}" then restart',
    "access_token={secret}",
    "password: {secret_short}",
    "the password is {secret_short} for all",
    "passwd = {secret_short} was set",
    "we found {secret_key} in the log",
    "{secret_key} was sent by mail",
    "export it as {secret_key}.",
    "my name is {name} and i live here",
    "hello, my name is {name}.",
    "Dear Mr {name}, thank you for the letter",
    "signed by Dr. {name}, in may",
    "we met Mrs. {name} at noon",
    "mein name ist {name} und ich bin neu",
    "je m'appelle {name} et je viens",
    "me llamo {name} y soy de aquí",
    "she lives at {address} in the old town",
    "send it to {address}.",
    "the shop moved to {address}, second floor",
    "ssn {account_ssn} of the person",
    "SSN: {account_ssn}",
    "iban {account_iban} by monday",
    "IBAN: {account_iban}",
    "account number {account_long} was closed",
    "from account {account_long} to account {account_long}",
    "passport no. {account_pass} expired",
    "we read 1024 pages in 2019 and 2020",
    "the price is 12.50 or 1,000 in all",
    "version 3.2.1 of the programme, page 42",
    "chapter 12 has 3500 words",
    'he said "a word" and = was the sign',
    "the token was a small coin",
    "a key opens the door",
    "the password was long and the account was old",
    "on account of 12 men the account of 1999 was long",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "on 2021-03-04 at 10:30 they met (again)",
    "und der weg ist nicht weit von hier",
    "la maison est près de la gare et du pont",
    "el libro de la casa y los árboles",
    "The end of the day was near, and nobody spoke.",
    "Thorn Entau Anle, Pfung and Laen went. Sher Onst Hewh",
    "name | value | total | rate",
    "{prose} | {number} | {prose}",
    "| {number} | {number} | {prose}",
    "the name of the rose and the name of The Great River",
    "Dear friends and readers, Mr and Mrs were out",
    "the street was long, the road was dark, 12 of them",
    "in 1999 King and Queen met on the Road to North",
    "call me at 5 or call 2 others, phone 3 of them",
    "WORD!! MORE!! LOUD!! TEXT!!",
    "see https://www.example.org/a/b for 10 more",
    "order no. 4711 of lot 000123456789 is open",
    "then {number} came and {number}, so {number}",
    *["{prose}"] * 8,
    *["{prose_run}"] * 4,
    "{prose} {number} {prose}",
    "{prose} Street was long and Road was dark",
    "{number} Baker said and {number} Miller said",
    "{prose} is {prose}",
    "a - b + c * d = e",
    "antidisestablishmentarianism supercalifragilistic is long",
    "well-known half-and-half so_called up-to-date",
)


def _forms(words: str) -> set[str]:
    return {y + end for x in words.split() for y in (x, x.capitalize(), x.upper()) for end in ("", ":")}


CONTEXT = (
    _forms("token access_token api_key apikey secret password passwd key auth"),
    {"=", ":", ":=", "=>"},
    _forms("card"),
    _forms("call tel tel. phone fax"),
    _forms("mail write contact to"),
    _forms("mr mr. mrs mrs. dr dr. ms ms."),
    _forms("is am ist llamo m'appelle"),
    _forms("name"),
    _forms("street street, street. st st. road road, road. avenue avenue, avenue. lane lane, lane. drive boulevard"),
    _forms("ssn iban account passport"),
    _forms("number no. nr nr."),
)


def _fill(kind: str, rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    one = lambda *x: str(rng.choice(x))
    if kind == "prose_run":
        x, end = letters(rng.integers(2, 9)).capitalize(), one("", "", ".", ",", "!!")
        each = [x] * 16 if rng.random() < 0.5 else [letters(rng.integers(2, 9)).capitalize() for _ in range(16)]
        return " ".join((x.upper() if end == "!!" else x) + end for x in each)
    if kind == "prose":
        how = one("plain", "plain", "caps", "loud")
        each = [letters(rng.integers(1, 11)) for _ in range(rng.integers(4, 9))]
        each = [x.upper() if how == "loud" else x.capitalize() if rng.random() < (0.7 if how == "caps" else 0.25) else x for x in each]
        return " ".join(x + (one(".", ".", ",", "!!", "***", ".***", "?", ":") if rng.random() < 0.35 else "") for x in each)
    if kind == "email":
        return f"{letters(rng.integers(3, 9))}{rng.choice(['.', '_', ''])}{digits(2)}@{letters(rng.integers(3, 8))}{rng.integers(0, 9)}.example.{rng.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        return ".".join(map(str, rng.integers(0, 256, 4)))
    if kind == "card":
        return digits(16) if rng.random() < 0.6 else f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}"
    if kind == "phone":
        return one(f"+1 ({digits(3)}) 555-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}")
    if kind == "phone_plain":
        return one(f"({digits(3)}) 555-{digits(4)}", f"0{digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(9)}")
    if kind == "name":
        return " ".join(letters(rng.integers(3, 9)).capitalize() for _ in range(rng.integers(1, 3)))
    if kind == "address":
        return f"{rng.integers(1, 999)} {' '.join(letters(rng.integers(3, 9)).capitalize() for _ in range(rng.integers(1, 3)))} {one('Street', 'Road', 'Avenue', 'Lane', 'St.')}"
    if kind == "account_ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "account_iban":
        head = letters(2).upper() + digits(2)
        return one(head + digits(18), f"{head} {digits(4)} {digits(4)} {digits(4)} {digits(2)}")
    if kind == "account_long":
        return digits(rng.integers(7, 13))
    if kind == "account_pass":
        return letters(1).upper() + digits(rng.integers(7, 9))
    if kind == "number":
        return digits(rng.integers(2, 18))
    if kind == "secret_short":
        return one(letters(rng.integers(4, 8)) + digits(rng.integers(1, 4)), letters(3).upper() + digits(2) + letters(3), letters(5) + "!" + digits(3))
    pool = "0123456789abcdef" if rng.random() < 0.6 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = "".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(20, 48))))
    if kind == "secret_key":
        pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" if rng.random() < 0.3 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        text = "".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(16, 40))))
        return one(letters(2) + "-" + text[:-2] + "a7", letters(3) + "_" + text[:-2] + "b3", letters(4) + f"-{digits(6)}-" + text[:-2] + "c9", "Q" + text[:-2] + "7Z")
    return text[:-2] + "a7"


def labelled_table(copies: int = 8, seed: int = 7) -> list[tuple[str, list[int]]]:
    """(sentence, label number of each word)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(copies):
        for sentence in SENTENCES:
            words, labels = [], []
            for part in sentence.split(" "):
                m = re.search(r"\{(\w+)\}", part)
                text = part.replace(m[0], _fill(m[1], rng)) if m else part
                kind = m[1].split("_")[0] if m and m[1].split("_")[0] in LABELS else "O"
                some = text.split(" ")
                for i, x in enumerate(some):
                    place = "" if not i or kind not in ("name", "address") else "+9" if kind == "address" and i == len(some) - 1 else f"+{i}"
                    words.append(x), labels.append(LABELS.index(kind + place))
            out.append((" ".join(words), labels))
    return out


# Kinds of bytes, one bit each: small letter or beyond ASCII, capital, digit, @, dot, hyphen or low line, quote, sign, other mark, letter beyond f.
BITS = 10
CLASS = np.zeros(256, np.int32)
for _c in range(256):
    _x = chr(_c)
    CLASS[_c] = 1 if _c >= 128 or "a" <= _x <= "z" else 2 if "A" <= _x <= "Z" else 4 if "0" <= _x <= "9" else {"@": 8, ".": 16, "-": 32, "_": 32, '"': 64, "'": 64, "=": 128, "+": 128}.get(_x, 256)
    if _c >= 128 or _x.isalpha() and _x not in "abcdefABCDEF":
        CLASS[_c] |= 512
LENGTHS = np.array([2, 4, 8, 16, 24, 64])
N_FEATURES = BITS * 2 + (len(LENGTHS) + 1) + len(CONTEXT) + 1


def shapes(w: Words) -> np.ndarray:
    """A code for each word, from which ``unfold`` tells its features."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    mask = np.bitwise_or.reduceat(CLASS[w.data], np.stack([w.start, w.end], 1).ravel())[::2]
    first = CLASS[w.data[w.start]]
    size = np.searchsorted(LENGTHS, w.end - w.start, "right")
    context = np.zeros(len(w.start), np.int64)
    names = w.hashes()
    for i, some in enumerate(_context_names()):
        context[np.isin(names, some)] = i + 1
    return ((mask.astype(np.int64) << 20) | (first << 8).astype(np.int64) | (size << 4) | context).astype(np.int64)


@functools.cache
def _context_names():
    with np.errstate(over="ignore"):
        return [Words([" ".join(sorted(x)).encode()]).hashes() for x in CONTEXT]


def unfold(codes: np.ndarray) -> np.ndarray:
    """Feature rows (0 or 1) of codes."""
    out = np.zeros((len(codes), N_FEATURES))
    mask, first, size, context = codes >> 20, codes >> 8 & 0xFFF, codes >> 4 & 15, codes & 15
    for b in range(BITS):
        out[:, b] = mask >> b & 1
        out[:, BITS + b] = first >> b & 1
    out[np.arange(len(codes)), 2 * BITS + size] = 1
    out[:, -1] = 1
    for i in range(len(CONTEXT)):
        out[:, 2 * BITS + len(LENGTHS) + 1 + i] = context == i + 1
    return out


class Field:
    """weights: (3, features, labels) for the previous, this and the next word; moves: (labels, labels)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(words, labels): what each word's features give each label.  first marks the first word of each line."""
        kinds, which = np.unique(codes, return_inverse=True)
        by = unfold(kinds).astype(np.float32)
        before, this, after = (np.vstack([by @ w, np.zeros((1, w.shape[1]), np.float32)]) for w in self.weights)
        none = len(kinds)
        prev = np.concatenate([[none], which[:-1]])
        prev[first] = none
        nxt = np.concatenate([which[1:], [none]])
        nxt[np.concatenate([first[1:], [True]])] = none
        out = before[prev] + this[which] + after[nxt]
        out[first] += NO_START
        return out


def train(table: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.15, l2: float = 0.0005) -> Field:
    """Maximum likelihood with a ridge, by Adam on the whole table.

    Words with equal codes share their features, so scores and gradients are taken once for each code of the table; the
    passes through the sentences multiply probabilities, scaled to a sum of one at each word.
    """
    w = Words([s.encode() for s, _ in table])
    y = np.concatenate([x for _, x in table])
    kinds, which = np.unique(shapes(w), return_inverse=True)
    by, none, size, k, n = unfold(kinds), len(kinds), w.count, len(LABELS), len(table)
    longest = int(size.max())
    here = np.arange(longest)[None, :] < size[:, None]
    code, gold = np.full((n, longest + 2), none), np.zeros((n, longest), np.int64)  # a word without features on both sides
    code[:, 1:-1][here], gold[here] = which, y
    around = [code[:, i : i + longest] for i in range(3)]  # previous, this and next word
    flat = [x[here] for x in around]

    def by_code(values: np.ndarray) -> np.ndarray:
        """(3 * features, labels): values of words, summed over each feature of the word before, the word and the word after."""
        sums = [np.stack([np.bincount(at, values[:, j], none + 1)[:none] for j in range(k)], 1) for at in flat]
        return np.concatenate([by.T @ x for x in sums])

    want_e = by_code(np.eye(k)[y])
    both = here[:, 1:]
    want_m = np.bincount((gold[:, :-1] * k + gold[:, 1:])[both], minlength=k * k).reshape(k, k).astype(float)
    p = [np.zeros((3 * N_FEATURES, k)), np.zeros((k, k))]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        parts = [np.vstack([by @ x, np.zeros((1, k))]) for x in p[0].reshape(3, N_FEATURES, k)]
        e = sum(part[at] for part, at in zip(parts, around, strict=True))
        e[:, 0] += NO_START
        e = np.exp(e - e.max(2, keepdims=True))
        moves = np.exp(p[1] + FORBIDDEN - p[1].max())
        a = np.zeros((n, longest, k))
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            z = (a[:, t - 1] @ moves) * e[:, t]
            a[:, t] = np.where(here[:, t, None], z / np.maximum(z.sum(1, keepdims=True), 1e-300), a[:, t - 1])
        b = np.full((n, longest, k), 1.0 / k)
        moved = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            z = e[:, t + 1] * b[:, t + 1]
            back = z @ moves.T
            total = np.maximum((a[:, t] * back).sum(1, keepdims=True), 1e-300)
            moved += (a[:, t] * here[:, t + 1, None] / total).T @ z * moves
            b[:, t] = np.where(here[:, t + 1, None], back / np.maximum(back.sum(1, keepdims=True), 1e-300), 1.0 / k)
        post = (a * b)[here]
        grads = [(want_e - by_code(post / post.sum(1, keepdims=True))) / n - l2 * p[0], (want_m - moved) / n - l2 * p[1]]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            p[i] = p[i] + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Field(p[0].reshape(3, N_FEATURES, k).astype(np.float32), (p[1] + FORBIDDEN).astype(np.float32))


@functools.cache
def default_field() -> Field:
    with np.errstate(over="ignore"):
        return train(labelled_table())


def viterbi(scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best label of each word; lines are decoded side by side, the longest first."""
    label = np.zeros(len(scores), np.int8)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    if not len(size) or not size[0]:
        return label
    back = np.zeros(scores.shape, np.int8)
    best = scores[begin[size > 0]]
    final = np.zeros(len(size), np.int8)
    for t in range(1, int(size[0]) + 1):
        live = int(np.searchsorted(-size, -t, "left")) if t > size[-1] else len(size)  # lines longer than t
        while live and size[live - 1] <= t:
            live -= 1
        final[live : len(best)] = best[live:].argmax(1)
        if not live:
            break
        z = best[:live, :, None] + moves
        at = begin[:live] + t
        back[at] = z.argmax(1)
        best = z.max(1) + scores[at]
        best -= best.max(1, keepdims=True)  # sums of a long line would lose digits
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))  # lines longer than t
        at = begin[:live] + t
        ends = size[:live] == t + 1
        if t + 1 < size[0]:
            more = ~ends
            label[at[more]] = back[at[more] + 1, label[at[more] + 1]]
        label[at[ends]] = final[:live][ends]
    return label


# A longer line is decoded in pieces of PIECE words side by side, each with SHARED words more at both ends, whose labels are its neighbours'.
# Where two pieces differ on a word at their border, the line is decoded whole.
PIECE, SHARED = 1000, 60
QUOTES = np.zeros(256, bool)
QUOTES[list(b"\"'`,;.()[]{}<>")] = True


def decode(scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best label of each word of lines that lie end to end; a step of the decoder takes a word of every piece of every line."""
    cuts = -(-size // PIECE)
    line = np.repeat(np.arange(len(size)), cuts)
    at = (np.arange(len(line)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
    left, right = np.maximum(at - SHARED, 0), np.minimum(at + PIECE + SHARED, size[line])
    if not (cuts > 1).any():
        return viterbi(scores, moves, begin, size)
    held = right - left
    start = np.cumsum(held) - held
    take = np.repeat(begin[line] + left - start, held) + np.arange(held.sum())
    many = viterbi(scores[take], moves, start, held)
    label, own = np.zeros(len(scores), np.int8), np.repeat(at, held)
    place = take - np.repeat(begin[line], held)
    inner = (place >= own) & (place < own + PIECE)
    label[take[inner]] = many[inner]
    near = np.where(place < own, own - place, place - own - PIECE + 1) <= SHARED // 2
    unlike = near & (many != label[take])
    for i in np.unique(np.repeat(line, held)[unlike]):
        some = slice(begin[i], begin[i] + size[i])
        label[some] = viterbi(scores[some], moves, np.zeros(1, np.int64), size[i : i + 1])
    return label


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """For each text the field's spans of the kinds in ADDED, in code points."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    w = Words([x.encode() for x in texts])
    n = len(w.start)
    if not n:
        return out
    breaks = np.cumsum(w.data == 10)
    line = breaks[w.start]
    first = np.ones(n, bool)
    first[1:] = line[1:] != line[:-1]
    heads = np.flatnonzero(first)
    label = decode(field.scores(shapes(w), first), field.moves, heads, np.diff(np.append(heads, n)))
    hit = np.flatnonzero(KEPT[label])
    if not len(hit):
        return out
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    text_start = w.text_end - np.array([len(x.encode()) + 1 for x in texts])
    start = 0
    while start < len(hit):
        end = start
        kind = BASE[label[hit[start]]]
        more = [i for i, x in enumerate(LABELS) if BASE[i] == kind and (x in PREVIOUS or kind not in ("name", "address"))]
        while end + 1 < len(hit) and hit[end + 1] == hit[end] + 1 and label[hit[end + 1]] in more and not first[hit[end + 1]]:
            end += 1
        a, b, doc = int(w.start[hit[start]]), int(w.end[hit[end]]), int(w.doc[hit[start]])
        cut = w.data[a:b].tobytes().rfind(b"=")  # name=value in one word
        if 0 <= cut < b - a - 1:
            a += cut + 1
        while a < b and QUOTES[w.data[a]] and not (kind == "phone" and w.data[a] == 40):
            a += 1
        close = w.data[a:b].tobytes().find(b'"')  # what follows a closing quote is not part of it
        if close > 0:
            b = a + close
        while a < b and QUOTES[w.data[b - 1]]:
            b -= 1
        if a < b:
            zero = lead[text_start[doc]]
            out[doc].append((kind, int(lead[a] - zero), int(lead[b] - zero)))
        start = end + 1
    return out


CHUNK = 400_000


DIGITS = range(8, 16)  # of a phone, by pattern or by the field


def _fits(text: str, span: tuple[str, int, int]) -> bool:
    """Whether an added span may be what it is called: a phone has as many digits as the pattern asks for."""
    kind, start, end = span
    return kind != "phone" or sum(c.isdecimal() for c in text[start:end]) in DIGITS


def find_batch(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(pattern spans, added spans that touch none of them) of each text."""
    out, at = [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        some = texts[at:end]
        with np.errstate(over="ignore"):
            added = field_spans(some, field)
        for text, more in zip(some, added, strict=True):
            base = pattern_spans(text)
            out.append((base, [s for s in more if _fits(text, s) and not any(s[1] < b and a < s[2] for _, a, b in base)]))
        at = end
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end); base by kind and start, added in order of the text."""
    ship(docs.sparkSession)
    field = field or default_field()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        names = ("kind", "start", "end")
        for batch in batches:
            found = find_batch([x or "" for x in batch["text"].to_pylist()], field)
            lists = [pa.array([[dict(zip(names, s, strict=True)) for s in f[i]] for f in found], kind) for i in (0, 1)]
            trim()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *lists], ["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, base {span}, added {span}")


def op3_pii_crf(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``find`` over the whole of documents; spans are base and added ones by kind (KINDS, then ADDED), then start."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    order = F.array(*[F.lit(k) for k in dict.fromkeys([*KINDS, *ADDED])])
    ranked = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(ranked)).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of touching spans becomes the name of its first span in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(spark, docs: DataFrame) -> DataFrame:
    """The documents with their spans replaced; n_chars follows where it is there."""
    ship(spark)
    field, names = default_field(), docs.columns

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = find_batch([x or "" for x in texts], field)
            fresh = [x if x is None else redact_text(x, [*a, *b]) for x, (a, b) in zip(texts, found, strict=True)]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(fresh, batch.schema.field("text").type)
            if "n_chars" in columns:
                sizes = [old if x is None else len(x) for x, old in zip(fresh, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(batch.schema.field("n_chars").type)
            trim()
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
