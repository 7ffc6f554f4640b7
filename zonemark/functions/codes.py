"""Codes in Python: what the driver folds literals with, and what tasks use for patterns.

A key is a signed 64-bit integer, country 10 bits, format 6, payload 48, with the top bit flipped, so that
keys compare as the codes' texts do.  Each format gives a code an order string whose text order is the
order of its payloads; a language over order strings turns every beginning into a run of codes.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from ..fixed import (
    CA_FIRST,
    CA_LETTERS,
    DIGIT_ZEROS,
    DROPPED,
    END_TAG,
    FIRST_PATTERN_TAG,
    FORMAT_TAGS,
    HYPHENS,
    IE_FIRST,
    IE_SYMBOLS,
    MALTESE,
    SPACES,
    UK_AREAS,
    UK_DISTRICT_LETTERS,
    UK_UNIT_LETTERS,
)
from ..plans.language import DIGITS, EMPTY, Language, any_of, build, language, seq

MIN_LONG = -(1 << 63)
_AREA = {a: k + 1 for k, a in enumerate(UK_AREAS)}


def key_of(raw: int) -> int:
    """The key of an unsigned 64-bit value."""
    return raw - (1 << 63)


def raw_of(key: int) -> int:
    return key + (1 << 63)


def pack_country(cc: str) -> int:
    return (ord(cc[0]) - 65) << 5 | (ord(cc[1]) - 65)


def country_of(key: int) -> str:
    c = raw_of(key) >> 54
    return chr(65 + (c >> 5)) + chr(65 + (c & 31))


def tag_of(key: int) -> int:
    return raw_of(key) >> 48 & 63


def payload_of(key: int) -> int:
    return raw_of(key) & (1 << 48) - 1


def assemble(cc: str, tag: int, payload: int) -> int:
    return key_of(pack_country(cc) << 54 | tag << 48 | payload)


def end_of(cc: str) -> int:
    """The bound above all codes of a country."""
    return assemble(cc, END_TAG, 0)


# ---- text -----------------------------------------------------------------------------------------------


@functools.cache
def respelling() -> tuple[str, str]:
    """(from, to) for a translation; characters past the end of ``to`` are dropped."""
    pairs = {chr(z + d): str(d) for z in DIGIT_ZEROS for d in range(10)}
    pairs |= {chr(c): "-" for c in HYPHENS} | {chr(c): " " for c in SPACES} | MALTESE
    pairs |= {chr(0xFF21 + k): chr(65 + k) for k in range(26)} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
    return "".join(pairs) + "".join(map(chr, DROPPED)), "".join(pairs.values())


@functools.cache
def _table() -> dict[int, str | None]:
    src, dst = respelling()
    return {ord(c): dst[k] if k < len(dst) else None for k, c in enumerate(src)}


def tidy(text: str) -> str:
    t = re.sub(r"[ \t\n\r]+", " ", text.translate(_table()))
    return re.sub(" *- *", "-", t).strip(" ")


def upper(text: str) -> str:
    """ASCII only: other letters must not turn into ASCII ones."""
    return text.translate(_UPPER)


_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def spellings(text: str, cc: str) -> list[str]:
    """The text and its re-spellings, in the order in which they are tried."""
    bases = [text]
    if upper(text[:2]) == cc:
        rest = text[2:]
        rest = rest[1:] if rest[:1] in (" ", "-") else rest
        bases += [rest] if rest else []
    out: dict[str, None] = {}
    for b in bases:
        for s in (b, b.replace(" ", "-"), b.replace("-", " "), b.replace(" ", ""), b.replace(".", "")):
            out[s] = None
    return list(out)


def split_country(code: str, cc: str | None) -> tuple[str | None, str]:
    """(country, national part); a prefix and a given country must agree."""
    m = re.fullmatch(r"([A-Za-z]{2})-(.*)", code, re.S)
    if cc is not None and not re.fullmatch("[A-Za-z]{2}", cc):
        return None, code
    if m:
        own = upper(m[1])
        return (own, m[2]) if cc is None or upper(cc) == own else (None, code)
    return (upper(cc), code) if cc is not None else (None, code)


# ---- UK postcodes ---------------------------------------------------------------------------------------

_UK_FULL = re.compile(r"([A-Z]{1,2})([0-9])(?:([A-Z0-9]?) *([0-9])|([0-9]) +)([A-Z]{2})")
_UK_PART = [
    re.compile(r"([A-Z]{1,2})()()()()"),
    re.compile(r"([A-Z]{1,2})([0-9])([A-Z0-9]?) *()()"),
    re.compile(r"([A-Z]{1,2})([0-9])([A-Z0-9]?) *([0-9])()"),
]
UK_SHIFTS = (24, 20, 14, 10, 5, 0)


def uk_fields(text: str, partial: bool) -> tuple[int, int, int, int, int, int] | None:
    """area, district 1 and 2, sector, walk 1 and 2 as they are stored; 0 is absent."""
    if len(text) > 32:
        return None
    t = upper(text)
    m = _UK_FULL.fullmatch(t)
    if m:
        area, d1, d2, sector, alone, walk = m.groups()
        d2, sector = ("", alone) if alone else (d2, sector)
    else:
        m = next((m for p in _UK_PART if (m := p.fullmatch(t))), None) if partial else None
        if not m:
            return None
        area, d1, d2, sector, walk = m.groups()
    if area not in _AREA or (sector and d1 == "0" and d2.isdigit()):
        return None
    dig = lambda c: ord(c) - 47 if c else 0
    return _AREA[area], dig(d1), dig(d2), dig(sector), *((ord(walk[0]) - 64, ord(walk[1]) - 64) if walk else (0, 0))


def uk_pack(f: tuple[int, ...]) -> int:
    return sum(x << s for x, s in zip(f, UK_SHIFTS))


def uk_unpack(v: int) -> tuple[int, ...]:
    return v >> 24 & 255, v >> 20 & 15, v >> 14 & 63, v >> 10 & 15, v >> 5 & 31, v & 31


def uk_text(f: tuple[int, ...]) -> str:
    area, d1, d2, sector, w1, w2 = f
    out = UK_AREAS[area - 1] + (chr(d1 + 47) if d1 else "") + (chr(d2 + 47) if d2 else "")
    return out + (f" {chr(sector + 47)}" if sector else "") + (chr(w1 + 64) if w1 else "") + (chr(w2 + 64) if w2 else "")


# ---- formats --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Format:
    """A way to write codes: ``order`` reads a text as an order string (None if it is no code), ``begin``
    reads the beginning of one; pack and unpack are between order strings and payloads."""

    name: str
    tag: int

    def lang(self) -> Language:
        raise NotImplementedError

    def order(self, text: str) -> str | None:
        raise NotImplementedError

    def begin(self, text: str) -> tuple[int, int] | None:
        """Ranks [lo, hi) of the codes that begin like this."""
        return self.lang().span(upper(text)) if text else None

    def pack(self, order: str) -> int:
        raise NotImplementedError

    def unpack(self, payload: int) -> str | None:
        raise NotImplementedError

    def written(self, order: str) -> str:
        return order

    def parse(self, text: str) -> int | None:
        o = self.order(text)
        return None if o is None else self.pack(o)

    def span(self, text: str) -> tuple[int, int | None] | None:
        """Payloads [lo, hi) of a beginning; hi is None at the end of the country."""
        r = self.begin(text)
        if r is None:
            return None
        lang = self.lang()
        return self.pack(lang.text(r[0])), self.pack(lang.text(r[1])) if r[1] < lang.size else None

    def text(self, payload: int) -> str | None:
        o = self.unpack(payload)
        return None if o is None else self.written(o)

    def outcode(self, payload: int) -> int | None:
        raise NotImplementedError


_NATIONAL = {
    # accepted text, canonical text
    "US": (r"([0-9]{5})(?:[- ]?(?!0000)([0-9]{4}))?", r"\d{5}(-([1-9]\d{3}|0[1-9]\d{2}|00[1-9]\d|000[1-9]))?"),
    "CA": (rf"([{CA_FIRST}][0-9][{CA_LETTERS}])([0-9][{CA_LETTERS}][0-9])?", rf"[{CA_FIRST}]\d[{CA_LETTERS}]( \d[{CA_LETTERS}]\d)?"),
    "FR": (r"([0-9]{5})(?: +CEDEX(?: +[0-9]{0,2})? *)?()", r"\d{5}"),
    "BR": (r"([0-9]{5})(?:-?([0-9]{3}))?", r"\d{5}(-\d{3})?"),
    "CZ": (r"([0-9]{3}) ?([0-9]{2})", r"\d{3} \d{2}"),
    "LU": (r"(?:L-?)?([0-9]{4})()", r"L-\d{4}"),
    "IE": (rf" *([{IE_FIRST}][0-9][0-9]|D6W) *([{IE_SYMBOLS}]{{4}})? *", rf"([{IE_FIRST}]\d\d|D6W)( [{IE_SYMBOLS}]{{4}})?"),
}
_JOINS = {"US": "-", "CA": " ", "BR": "-", "CZ": " ", "IE": " ", "FR": "", "LU": ""}
_COARSE = {"US": 14, "CA": 14, "BR": 11, "IE": 21}


class National(Format):
    """One or two groups of characters, each packed into its own bits."""

    def lang(self) -> Language:
        return language(_NATIONAL[self.name][1])

    def begin(self, text: str) -> tuple[int, int] | None:
        t = upper(text)
        if self.name == "LU" and t and not t.startswith("L"):
            t = "L-" + t
        return self.lang().span(t) if t else None

    def order(self, text: str) -> str | None:
        t = upper(text)
        m = re.fullmatch(_NATIONAL[self.name][0], t.replace(" ", "") if self.name == "CA" else t)
        if not m:
            return None
        a, b = m[1], m[2] or ""
        return ("L-" if self.name == "LU" else "") + a + (_JOINS[self.name] + b if b else "")

    def pack(self, order: str) -> int:
        s = order.replace(" ", "").replace("-", "").removeprefix("L" if self.name == "LU" else "\0")
        match self.name:
            case "US":
                return int(s[:5]) << 14 | int(s[5:] or 0)
            case "BR":
                return int(s[:5]) << 11 | (1 << 10 | int(s[5:]) if s[5:] else 0)
            case "CA":
                let = lambda c: ord(c) - 65
                low = 1 << 13 | int(s[3]) << 9 | let(s[4]) << 4 | int(s[5]) if s[3:] else 0
                return let(s[0]) << 23 | int(s[1]) << 19 | let(s[2]) << 14 | low
            case "IE":
                x = [IE_SYMBOLS.index(c) for c in s]
                low = 1 << 20 | x[3] << 15 | x[4] << 10 | x[5] << 5 | x[6] if x[3:] else 0
                return x[0] << 31 | x[1] << 26 | x[2] << 21 | low
        return int(s)

    def unpack(self, p: int) -> str | None:
        match self.name:
            case "US":
                out = f"{p >> 14:05d}" + (f"-{p & 16383:04d}" if p & 16383 else "")
            case "BR":
                out = f"{p >> 11:05d}" + (f"-{p & 1023:03d}" if p & 1024 else "")
            case "CA":
                let = lambda k: chr(65 + (k & 31))
                out = let(p >> 23) + str(p >> 19 & 15) + let(p >> 14)
                out += f" {p >> 9 & 15}{let(p >> 4)}{p & 15}" if p & 1 << 13 else ""
            case "IE":
                if any((p >> s & 31) >= len(IE_SYMBOLS) for s in (31, 26, 21, 15, 10, 5, 0)):
                    return None
                sym = lambda s: IE_SYMBOLS[p >> s & 31]
                out = sym(31) + sym(26) + sym(21) + (" " + sym(15) + sym(10) + sym(5) + sym(0) if p & 1 << 20 else "")
            case "CZ":
                out = f"{p:05d}"
                out = out[:3] + " " + out[3:]
            case "LU":
                out = f"L-{p:04d}"
            case _:
                out = f"{p:05d}"
        return out if self.lang().rank(out, False) is not None and self.pack(out) == p else None

    def outcode(self, payload: int) -> int | None:
        s = _COARSE.get(self.name)
        return None if s is None else payload >> s << s


class British(Format):
    """The UK layout; an order string has a character for the area's number, two for the district (an absent
    second one is "!"), and three for the rest."""

    def lang(self) -> Language:
        return _british()

    @staticmethod
    def _order(f: tuple[int, ...]) -> str:
        area, d1, d2, sector, w1, w2 = f
        out = chr(0xE000 + area)
        if d1:
            out += chr(d1 + 47) + (chr(d2 + 47) if d2 else "!")
        return out + (chr(sector + 47) if sector else "") + (chr(w1 + 64) if w1 else "") + (chr(w2 + 64) if w2 else "")

    def order(self, text: str) -> str | None:
        f = uk_fields(text, True)
        if f is None or not f[1]:
            return None
        o = self._order(f)
        return o if self.lang().rank(o, False) is not None else None

    def begin(self, text: str) -> tuple[int, int] | None:
        f = uk_fields(text, True)
        if f is None and upper(text[-1:]).isalpha():  # a sector and the first letter of a unit
            head = uk_fields(text[:-1], True)
            f = (*head[:4], ord(upper(text[-1])) - 64, 0) if head and head[3] and not head[4] else None
        got = self.lang().walk(self._order(f), False) if f else None
        return None if got is None else (got[0], got[0] + self.lang().count[got[1]])

    def pack(self, order: str) -> int:
        dig = lambda c: 0 if c == "!" else ord(c) - 47
        tail = (ord(order[3]) - 47, ord(order[4]) - 64, ord(order[5]) - 64) if order[3:] else (0, 0, 0)
        return uk_pack((ord(order[0]) - 0xE000, dig(order[1]), dig(order[2]), *tail))

    def unpack(self, payload: int) -> str | None:
        f = uk_unpack(payload)
        if payload >> 32 or not 1 <= f[0] <= len(UK_AREAS) or not f[1]:
            return None
        o = self._order(f)
        return o if self.lang().rank(o, False) is not None and self.pack(o) == payload else None

    def written(self, order: str) -> str:
        return uk_text(uk_unpack(self.pack(order)))

    def outcode(self, payload: int) -> int | None:
        return payload >> 14 << 14


@functools.cache
def _british() -> Language:
    one = lambda cs: ("one", frozenset(cs), None)
    kinds = []
    for n, letters in UK_DISTRICT_LETTERS.items():
        areas = one(chr(0xE000 + k) for a, k in _AREA.items() if len(a) == n)
        rest = frozenset("!" + letters)
        kinds += [seq(areas, seq(one("0"), one(rest | DIGITS - {"0"}))), seq(areas, seq(one(DIGITS - {"0"}), one(rest | DIGITS)))]
    unit = seq(one(DIGITS), seq(one(UK_UNIT_LETTERS), one(UK_UNIT_LETTERS)))
    return build(seq(any_of(*kinds), any_of(unit, EMPTY)))


@dataclass(frozen=True)
class Patterned(Format):
    """A version of a country's pattern; the payload is the code's rank."""

    regex: str

    def lang(self) -> Language:
        return language(self.regex)

    def order(self, text: str) -> str | None:
        got = self.lang().walk(upper(text))
        return got[2] if got and self.lang().ends[got[1]] else None

    def pack(self, order: str) -> int:
        return self.lang().rank(order, False)

    def unpack(self, payload: int) -> str | None:
        return self.lang().text(payload)

    def outcode(self, payload: int) -> int | None:
        return self.lang().outcode(payload) if self.lang().has_outcode else None


COMPILED: dict[str, Format] = {n: (British if n == "GB" else National)(n, t) for n, t in FORMAT_TAGS.items()}
BY_TAG: dict[int, Format] = {f.tag: f for f in COMPILED.values()}


def pattern_format(version: int, regex: str) -> Patterned:
    return Patterned("pattern", FIRST_PATTERN_TAG + version - 1, regex)
