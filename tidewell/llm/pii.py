"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The base spans are the leftmost non-overlapping matches of one pattern a kind, with its check.  The field
works on sites, the stretches of a text that can hold a candidate (around an at-sign, or digits and their
separators), cut into atoms (runs of digits, runs of letters, single other characters).  Candidate segments of
up to LONGEST atoms are scored as wholes, by features of all their characters and of what stands beside them, and
a dynamic program over segment ends and kinds chooses boundaries and kinds together; outside an entity each
atom is a segment of its own.  No candidate crosses the ends of a site, so sites are decoded one by one; time grows
with the length of a text, and a site of any length is decoded with scores of its last LONGEST atoms alone.
The weights are fitted by conditional likelihood (forward and backward sums over all segmentations) on generated
examples and on a bounded sample of the documents, labelled by the base patterns.  Spans of the field that
overlap no base span are added.

Defined results: a null text is an empty one and has no span; offsets are code points, ends exclusive; each
row is judged by itself, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Atoms of a candidate, and characters of an atom in it, at most; digits of a number that is no address, at least.
LONGEST = 24
LONGEST_ATOM = 64
LEAST_DIGITS = 7
#: What the field is fitted on at most: distinct texts, sites in them, characters of such a site; and generated lines.
SAMPLE_DOCS = 200
SAMPLE_SITES = 150
LONGEST_SITE = 120
#: Scores of feature sets that a field remembers.
MET = 1 << 15
GENERATED = 480
EPOCHS = 6
RATE = 0.25
DECAY = 1e-4

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """A match holds an at-sign and starts where the run of allowed characters before it starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, by start and then by kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- sites and atoms -----------------------------------------------------------------------------------

_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_NUMERIC = re.compile(r"[+(]{0,3}[0-9][0-9 ().+-]*")


def _email_sites(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        while end < len(text) and text[end] in _LOCAL:
            end += 1
        yield start, end
        done, at = at + 1, text.find("@", at + 1)


def sites(text: str) -> Iterator[tuple[int, int]]:
    """The stretches, apart from each other, that can hold a candidate; no candidate crosses their ends."""
    found = list(_email_sites(text))
    for m in _NUMERIC.finditer(text):
        own = m[0].rstrip(" ().+-")
        if len(own) >= LEAST_DIGITS and (own.count(".") >= 3 or len(_digits(own)) >= LEAST_DIGITS):
            found.append((m.start(), m.start() + len(own)))
    found.sort()
    held: tuple[int, int] | None = None
    for a, b in found:
        if held and a <= held[1]:
            held = held[0], max(held[1], b)
        else:
            if held:
                yield held
            held = a, b
    if held:
        yield held


def atoms(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, a, b)]


def candidates(text: str, cut: Sequence[tuple[int, int]], j: int) -> Iterator[int]:
    """The atoms, backwards, with which a candidate that ends with atom j - 1 may start.

    A candidate has at most LONGEST atoms of at most LONGEST_ATOM characters, ends with an ASCII letter or digit, and
    either has one at-sign and no blank, or is a number: digits and their separators, LEAST_DIGITS to 19 digits, or
    four runs of digits with points between.
    """
    end = cut[j - 1][1]
    if not (text[end - 1].isascii() and text[end - 1].isalnum()):
        return
    digits = at = points = 0
    number = mail = True
    for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
        a, b = cut[i]
        c = text[a]
        if b - a > LONGEST_ATOM:
            return
        if "0" <= c <= "9":
            digits += b - a
            number = number and digits <= 19
        elif c == "@":
            at, number = at + 1, False
        elif c.isalpha():
            number, mail = False, mail and text[a:b].isascii()
        elif c in " ()":
            mail = False
        elif c in "_%":
            number = False
        elif c == ".":
            points += 1
        elif c not in "+-":
            return
        mail = mail and at <= 1
        if not (number or mail):
            return
        starts = c.isalnum()
        if number and (starts or c in "+(") and (digits >= LEAST_DIGITS or (starts and points == 3 and j - i == 7)):
            yield i
        elif mail and at == 1 and starts:
            yield i


# --- features ------------------------------------------------------------------------------------------

_CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "addr"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call", "fax", "mob")}


def _is_digit(c: str) -> bool:
    """One of 0-9: other scripts' digits and superscripts are no digits here."""
    return "0" <= c <= "9"


def _beside(c: str) -> str:
    return "^" if not c else "d" if _is_digit(c) else "a" if c.isalpha() else "_" if c.isspace() else c if c in "+@.-(" else "p"


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole candidate span."""
    s = text[a:b]
    digits = _digits(s)
    letters = sum(map(str.isalpha, s))
    n = len(digits)
    f = [f"n{min(n, 20)}", f"l{min(letters, 3)}", f"f{_beside(s[0])}", f"e{_beside(s[-1])}", f"b{_beside(text[a - 1 : a])}", f"a{_beside(text[b : b + 1])}"]
    local, at, domain = s.partition("@")
    if at:
        f.append("at" if local and "." in domain and _DOMAIN.fullmatch(domain) and set(local) <= _LOCAL else "bad-at")
    elif not letters:
        parts = s.split(".")
        if len(parts) == 4 and all(p and len(p) == len(_digits(p)) for p in parts):
            f.append("quad" if all(len(p) < 4 and int(p) < 256 for p in parts) else "bad-quad")
        if 14 <= n <= 19 and set(s) <= set("0123456789 -"):
            f.append("luhn" if luhn(digits) else "no-luhn")
        if s[0] == "+" and 10 <= n <= 15:
            f.append("plus-digits")
        groups = re.findall(r"[0-9]+", s)
        f.append("seps" + "".join(sorted({c for c in s if not _is_digit(c)}))[:6])
        f.append("groups" + "-".join(str(min(len(g), 5)) for g in groups[-3:]) + ("" if len(groups) < 4 else "+"))
    if n and letters:
        f.append("mixed")
    before = text[max(0, a - 16) : a].lower()
    f += [f"cue-{k}" for k, cues in _CUES.items() if any(c in before for c in cues)]
    return f


def atom_feature(text: str, a: int, b: int) -> str:
    c = text[a]
    return f"o{_beside(c)}{min(b - a, 9)}"


# --- the field -----------------------------------------------------------------------------------------


@dataclass
class Lattice:
    """All candidates of a short site, for the fit: atom numbers, features, and which end at each atom."""

    n: int
    spans: list[tuple[int, int]]
    features: list[list[str]]
    by_end: list[list[int]]


def lattice(text: str, cut: list[tuple[int, int]]) -> Lattice:
    spans, features, by_end = [], [], [[] for _ in range(len(cut) + 1)]
    for j in range(1, len(cut) + 1):
        for i in candidates(text, cut, j):
            by_end[j].append(len(spans))
            spans.append((i, j))
            features.append(segment_features(text, cut[i][0], cut[j - 1][1]))
    return Lattice(len(cut), spans, features, by_end)


class _Atoms(Sequence):
    """The atoms of a site as two arrays of 32-bit numbers."""

    def __init__(self, text: str, a: int, b: int):
        self.starts, self.ends = array("i"), array("i")
        for m in _ATOM.finditer(text, a, b):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> tuple[int, int]:
        return self.starts[k], self.ends[k]


class Field:
    """Weights of (kind, feature), of an atom outside entities, and of each pair of neighbouring kinds."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.outside: dict[str, float] = {}
        self.pair = np.zeros((OTHER + 1, OTHER + 1))
        self.met: dict[tuple[str, ...], list[float]] = {}

    def _ids(self, features: list[str], grow: bool) -> list[int]:
        if grow:
            for f in features:
                self.index.setdefault(f, len(self.index))
            if len(self.index) > len(self.w):
                self.w = np.vstack([self.w, np.zeros((max(64, len(self.index) - len(self.w)), len(KINDS)))])
        return [self.index[f] for f in features if f in self.index]

    def scores(self, lat: Lattice) -> np.ndarray:
        """(segments, kinds)."""
        out = np.zeros((len(lat.spans), len(KINDS)))
        for k, f in enumerate(lat.features):
            ids = self._ids(f, False)
            if ids:
                out[k] = self.w[ids].sum(axis=0)
        return out

    def score(self, features: list[str]) -> list[float]:
        """The score of one candidate for each kind; few sets of features are met again and again."""
        key = tuple(features)
        found = self.met.get(key)
        if found is None:
            if len(self.met) >= MET:
                self.met.clear()
            ids = self._ids(features, False)
            found = self.met[key] = self.w[ids].sum(axis=0).tolist() if ids else [0.0] * len(KINDS)
        return found

    def _forward(self, lat: Lattice, score: np.ndarray, out: list[float], best: bool):
        """Log sums (or maxima with back pointers) over segmentations that end at each atom with each kind."""
        a = np.full((lat.n + 1, OTHER + 1), -np.inf)
        a[0, OTHER] = 0.0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        for j in range(1, lat.n + 1):
            options: list[list[tuple[float, int, int]]] = [[] for _ in range(OTHER + 1)]
            reach = a[j - 1][:, None] + self.pair
            options[OTHER] = [(reach[p, OTHER] + out[j - 1], j - 1, p) for p in range(OTHER + 1) if a[j - 1, p] > -np.inf]
            for k in lat.by_end[j]:
                i = lat.spans[k][0]
                for p in range(OTHER + 1):
                    if a[i, p] > -np.inf:
                        for y in range(len(KINDS)):
                            options[y].append((a[i, p] + self.pair[p, y] + score[k, y], i, p))
            for y, found in enumerate(options):
                if found:
                    top = max(found)
                    if best:
                        a[j, y], back[j, y] = top[0], (top[1], top[2], y)
                    else:
                        a[j, y] = top[0] + math.log(sum(math.exp(x[0] - top[0]) for x in found))
        return a, back

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a site.  Scores are kept for the last LONGEST atoms alone, and 26 bytes an atom."""
        cut = _Atoms(text, a, b)
        n, kinds = len(cut), len(KINDS)
        pair, memory = self.pair.tolist(), LONGEST + 1
        length, before = np.zeros((n + 1, OTHER + 1), np.int8), np.full((n + 1, OTHER + 1), OTHER, np.int8)
        lowest = float("-inf")
        value = [lowest] * kinds + [0.0]
        into: list = [None] * memory  # of each kept atom: the best way into each kind, and from which kind
        for j in range(n + 1):
            if j:
                best, p = into[(j - 1) % memory][OTHER]
                value = [lowest] * kinds + [best + self.outside.get(atom_feature(text, *cut[j - 1]), 0.0)]
                length[j, OTHER], before[j, OTHER] = 1, p
                for i in candidates(text, cut, j):
                    found = self.score(segment_features(text, cut[i][0], cut[j - 1][1]))
                    for y in range(kinds):
                        reach, p = into[i % memory][y]
                        if reach + found[y] > value[y]:
                            value[y] = reach + found[y]
                            length[j, y], before[j, y] = j - i, p
            into[j % memory] = [max((value[p] + pair[p][y], p) for p in range(OTHER + 1)) for y in range(OTHER + 1)]
        out, j, y = [], n, max(range(OTHER + 1), key=value.__getitem__)
        while j > 0:
            i = j - int(length[j, y])
            if y != OTHER:
                out.append((KINDS[y], cut[i][0], cut[j - 1][1]))
            j, y = i, int(before[j, y])
        return out[::-1]

    def step(self, text: str, cut: list[tuple[int, int]], gold: list[Span], rate: float) -> None:
        """One ascent of the log likelihood of a region's labels."""
        lat = lattice(text, cut)
        for f in lat.features:
            self._ids(f, True)
        names = [atom_feature(text, *c) for c in cut]
        score, out = self.scores(lat), [self.outside.get(x, 0.0) for x in names]
        a, _ = self._forward(lat, score, out, False)
        z = np.logaddexp.reduce(a[lat.n])
        b = np.full((lat.n + 1, OTHER + 1), -np.inf)
        b[lat.n] = 0.0
        by_start: list[list[int]] = [[] for _ in range(lat.n + 1)]
        for k, (i, _) in enumerate(lat.spans):
            by_start[i].append(k)
        expected = np.zeros_like(score)
        pair = np.zeros_like(self.pair)
        outside: dict[str, float] = {}
        for i in range(lat.n - 1, -1, -1):
            into = np.full((1 + len(by_start[i]), OTHER + 1), -np.inf)
            into[0, OTHER] = out[i] + b[i + 1, OTHER]
            for r, k in enumerate(by_start[i], 1):
                into[r, : len(KINDS)] = score[k] + b[lat.spans[k][1], : len(KINDS)]
            per_kind = np.logaddexp.reduce(into, axis=0)
            b[i] = np.logaddexp.reduce(self.pair + per_kind[None, :], axis=1)
            reach = np.logaddexp.reduce(a[i][:, None] + self.pair, axis=0)
            with np.errstate(invalid="ignore"):
                p = np.exp(np.nan_to_num(reach[None, :] + into - z, nan=-np.inf))
                pair += np.exp(np.nan_to_num(a[i][:, None] + self.pair + per_kind[None, :] - z, nan=-np.inf))
            outside[names[i]] = outside.get(names[i], 0.0) + p[0, OTHER]
            for r, k in enumerate(by_start[i], 1):
                expected[k] += p[r, : len(KINDS)]
        starts, ends = {c[0]: n for n, c in enumerate(cut)}, {c[1]: n + 1 for n, c in enumerate(cut)}
        where = {s: k for k, s in enumerate(lat.spans)}
        change, at, last = -expected, 0, OTHER
        told = {starts[x[1]]: (ends[x[2]], KINDS.index(x[0])) for x in gold if x[1] in starts and x[2] in ends and (starts[x[1]], ends[x[2]]) in where}
        outside = {k: -v for k, v in outside.items()}
        while at < lat.n:
            if at in told:
                end, y = told[at]
                change[where[at, end], y] += 1
            else:
                end, y = at + 1, OTHER
                outside[names[at]] = outside.get(names[at], 0.0) + 1
            pair[last, y] -= 1
            at, last = end, y
        self.met.clear()
        self.w *= 1 - rate * DECAY
        for k in np.flatnonzero(np.abs(change).max(axis=1) > 1e-6) if len(change) else ():
            np.add.at(self.w, self._ids(lat.features[k], False), rate * change[k])
        for x, v in outside.items():
            self.outside[x] = self.outside.get(x, 0.0) + rate * v
        self.pair -= rate * pair


def without_overlap(spans: list[Span]) -> list[Span]:
    """Each span that overlaps no earlier and longer one."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda x: (x[1], -x[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def generated(n: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Labelled lines made by rule: each kind in several forms, and numbers and codes that are no personal data."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice([body, " ".join(body[k : k + 4] for k in range(0, 16, 4)), "-".join(body[k : k + 4] for k in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.choice(['44', '49', '33'])} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"])

    kinds = {
        "email": lambda: f"{word()}{rng.choice(['.', '_', '', '+'])}{word()}{rng.choice(['', number(2)])}@{word()}.{rng.choice(['com', 'org', 'net', 'co.uk', 'de'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    plain = [
        lambda: number(rng.randint(1, 13)),
        lambda: number(16),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["", f" {number(2)}:{number(2)}", f" - {rng.randint(1900, 2030)}"]),
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}",
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda: f"{number(3)}.{number(3)}.{number(4)}.{number(3)}9",
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(32))}"',
        lambda: f"${number(3)}.{number(2)}",
        lambda: f"{number(2)}:{number(2)}",
        lambda: rng.choice([" ", ".", "-"]).join(number(rng.randint(1, 2)) for _ in range(rng.randint(5, 9))),
        lambda: " ".join(number(5) for _ in range(rng.randint(2, 4))),
        lambda: f"@{word()}",
        lambda: f"{word()}@{word()}",
        lambda: f"{word()[:1]}@{word()[:1]}@{word()}",
        lambda: f"v{number(1)}.{number(1)}",
    ]
    out = []
    for k in range(n):
        kind = KINDS[k % 8] if k % 8 < 4 else None
        s = kinds[kind]() if kind else rng.choice(plain)()
        if not kind and luhn(_digits(s)) and 14 <= len(_digits(s)) <= 19 and base_spans(s):
            s = s[:-1] + str((int(s[-1]) + 1) % 10)
        before = " ".join(word() for _ in range(rng.randint(0, 3))) + rng.choice(["", "", " tel:", " mail:", " card"])
        text = f"{before} {s}{rng.choice(['', '.', ','])} {word()}"
        at = len(before) + 1
        out.append((text, [(kind, at, at + len(s))] if kind else []))
    return out


def training_sites(text: str) -> list[tuple[str, int, list[Span]]]:
    """The short sites of a document with some text before and after: that text, the site's place in it, labels.

    Labels are the base spans.  A site without one counts as no entity only if it is a single run of digits, since
    a number in groups may be an entity that the base patterns miss.
    """
    base, out = without_overlap(base_spans(text)), []
    for a, b in sites(text):
        own = [s for s in base if a <= s[1] and s[2] <= b]
        if b - a <= LONGEST_SITE and (own or _digits(text[a:b]) == text[a:b]):
            shift = max(0, a - 20)
            out.append((text[shift : b + 5], a - shift, b - shift, [(k, x - shift, y - shift) for k, x, y in own]))
    return out


def fit(found: list[tuple[str, int, int, list[Span]]], seed: int = 7) -> Field:
    """A field fitted on generated lines and on these sites of documents (text, start, end, labels)."""
    rows = [(text, atoms(text, a, b), gold) for text, a, b, gold in found]
    for text, gold in generated(GENERATED, seed):
        rows += [(text, atoms(text, a, b), gold) for a, b in sites(text)]
    field, rng = Field(), random.Random(seed)
    for epoch in range(EPOCHS):
        rng.shuffle(rows)
        for text, cut, gold in rows:
            field.step(text, cut, gold, RATE / (1 + epoch))
    return field


def all_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The base spans and those of the field that overlap none of them."""
    if not _TRIGGER.search(text):
        return base
    added = []
    covered, first = without_overlap(base), 0
    for a, b in sites(text):
        while first < len(covered) and covered[first][2] <= a:
            first += 1
        last = first
        while last < len(covered) and covered[last][1] < b:
            last += 1
        own = covered[first:last]
        if own and own[0][1] <= a and own[0][2] >= b:
            continue
        at = 0
        for s in field.decode(text, a, b):
            while at < len(own) and own[at][2] <= s[1]:
                at += 1
            if at == len(own) or own[at][1] >= s[2]:
                added.append(s)
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its first kind."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def fitted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_sites: int = SAMPLE_SITES) -> Field:
    """A field fitted on at most sample_sites sites of at most sample_docs distinct texts, those of the smallest hashes.

    A bound on the hash keeps all but some dozen times as many rows from being moved; it is widened until it holds
    enough distinct texts or all of them.  Only sites of at most LONGEST_SITE characters reach the driver.
    """
    rows, share = docs.count(), 1.0
    if rows > 64 * sample_docs:
        share = 64 * sample_docs / rows
    while True:
        bound = F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else F.lit((1 << 63) - 1)
        holds = docs.select("text", F.xxhash64("text").alias("_h")).filter((F.col("_h") <= bound) & F.col("text").rlike("[0-9@]"))
        chosen = written(holds.dropDuplicates(["_h"]).orderBy("_h").limit(sample_docs), "pii-sample")
        if share >= 1 or chosen.count() >= sample_docs:
            break
        share = min(1.0, 64 * share)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (near, a, b, gold) in enumerate(training_sites(text)):
                    for column, x in zip(out, (h, n, near, a, b, [dict(zip(("kind", "start", "end"), s, strict=True)) for s in gold]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), span), strict=True)], ["h", "n", "near", "a", "b", "gold"])

    told = chosen.mapInArrow(cut, "h long, n int, near string, a int, b int, gold array<struct<kind:string,start:int,end:int>>")
    return fit([(r.near, r.a, r.b, [tuple(g) for g in r.gold]) for r in told.orderBy("n", "h").limit(sample_sites).collect()])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, base, spans): the base spans and all spans as arrays of (kind, start, end)."""
    model = field or fitted(docs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base_out, all_out = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                base_out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                all_out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(text, base, model)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, kind), pa.array(all_out, kind)], ["doc_id", "base", "spans"])

    shape = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {shape}, spans {shape}")


def digest(docs: DataFrame) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced, and n_chars, where there is one, set to the new length."""
    model = fitted(docs)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None or not _TRIGGER.search(t) else redact(t, all_spans(t, base_spans(t), model)))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
