"""Patterns that are one line of characters, with optional ends, as built-in expressions.

Most countries' patterns are a sequence of classes whose tail may be absent, perhaps in several steps.  A
choice between a few strings of one length is a place of its own, a block.
Ranks of such codes are numbers in a mixed radix: each place counts what can follow it, and going on
where a code could have ended counts one.  Reading is one regular expression and some arithmetic, writing
is division; no Python runs for them.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.language import EMPTY, language, nullable, steps

_SEPARATORS = (" ", "-")
#: Strings of a block.
MAX_BLOCK = 2000
Place = str | tuple[str, ...]


def _width(place: Place) -> int:
    return 1 if isinstance(place, str) else len(place[0])


def _one(c: str) -> str:
    return "\\" + c if c in "\\]^-[" else c


def _choice(strings: tuple[str, ...]) -> str:
    """A regular expression of strings of one length: first letters that go on alike are one class."""
    if not strings[0]:
        return ""
    rest: dict[str, list[str]] = {}
    for s in strings:
        rest.setdefault(s[0], []).append(s[1:])
    alike: dict[tuple[str, ...], str] = {}
    for c, tails in rest.items():
        alike[tuple(tails)] = alike.get(tuple(tails), "") + c
    out = ["[" + "".join(map(_one, cs)) + "]" + _choice(tails) for tails, cs in alike.items()]
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


@dataclass(frozen=True)
class Line:
    """Places with their characters, or blocks with their strings, in order; ``ends``: how many places a code
    may have, ascending."""

    places: tuple[Place, ...]
    ends: tuple[int, ...]

    @functools.cached_property
    def after(self) -> list[int]:
        """after[i]: how many codes share their first i characters."""
        out = [1] * (len(self.places) + 1)
        for i in range(len(self.places) - 1, -1, -1):
            out[i] = len(self.places[i]) * out[i + 1] + (i in self.ends)
        return out

    def segments(self) -> list[tuple[int, int]]:
        """Runs of places between ends; within them, runs of digits are one number."""
        cuts = [0, *self.ends]
        return list(zip(cuts, cuts[1:]))

    # ---- reading ----------------------------------------------------------------------------------------

    def regex(self) -> str:
        out = ""
        for k, (a, b) in enumerate(self.segments()):
            piece = ""
            for i in range(a, b):
                p = self.places[i]
                c = _choice(tuple(p))
                # a separator may be left out before what follows it
                piece += c + ("?" if p in _SEPARATORS and i + 1 < len(self.places) else "")
            out += f"(?:{piece}" if k else piece
        return out + ")?" * (len(self.ends) - 1)

    def rank(self, text: Column) -> Column:
        """The rank of a folded text, or null."""
        kept = [i for i, p in enumerate(self.places) if p not in _SEPARATORS]
        at = {i: 1 + sum(_width(self.places[j]) for j in kept if j < i) for i in kept}
        size = {e: sum(_width(self.places[j]) for j in kept if j < e) for e in self.ends}

        def read(s: Column) -> Column:
            total = F.lit(0).cast("long")
            for k, (a, b) in enumerate(self.segments()):
                here = F.lit(1 if k else 0).cast("long")
                for lo, hi, digits in self._runs(a, b):
                    if digits:
                        n = F.substring(s, at[lo], hi - lo).cast("long") - (10 ** (hi - lo - 1) if self.places[lo] == "123456789" else 0)
                    else:
                        n = _place(self.places[lo], F.substring(s, at[lo], _width(self.places[lo])))
                    here = here + n * F.lit(self.after[hi]).cast("long")
                total = total + (F.when(F.length(s) >= size[b], here).otherwise(F.lit(0).cast("long")) if k else here)
            return total

        # bare column expressions, so that all of it is generated code
        plain = F.translate(text, " -", "") if any(p in _SEPARATORS for p in self.places) else text
        return F.when(text.rlike(rf"^(?:{self.regex()})\z"), read(plain))

    def _runs(self, a: int, b: int) -> list[tuple[int, int, bool]]:
        """(first, end, is a number) for the places of a segment; separators are left out."""
        out: list[tuple[int, int, bool]] = []
        i = a
        while i < b:
            p = self.places[i]
            if p in _SEPARATORS:
                i += 1
            elif p in ("0123456789", "123456789"):
                j = i + 1
                while j < b and self.places[j] == "0123456789":
                    j += 1
                out.append((i, j, True))
                i = j
            else:
                out.append((i, i + 1, False))
                i += 1
        return out

    # ---- writing ----------------------------------------------------------------------------------------

    def text(self, rank: Column) -> Column:
        """The code of a rank; null if there is none."""

        def write(k: int, r: Column) -> Column:
            a, b = self.segments()[k]
            pieces: list[Column] = []
            i = a
            runs = {lo: (hi, digits) for lo, hi, digits in self._runs(a, b)}
            left = r
            while i < b:
                if i not in runs:
                    pieces.append(F.lit(self.places[i]))
                    i += 1
                    continue
                hi, digits = runs[i]
                unit = F.lit(self.after[hi]).cast("long")
                n = _div(left, self.after[hi])
                left = F.pmod(left, unit)
                if digits:
                    base = 10 ** (hi - i - 1) if self.places[i] == "123456789" else 0
                    pieces.append(F.lpad((n + base).cast("string"), hi - i, "0"))
                else:
                    w = _width(self.places[i])
                    pieces.append(F.substring(F.lit("".join(self.places[i])), (n * w + 1).cast("int"), F.lit(w)))
                i = hi
            if k + 1 < len(self.ends):
                pieces.append(F.when(left == 0, F.lit("")).otherwise(write(k + 1, left - 1)))
            return F.concat(*pieces)

        return F.when((rank >= 0) & (rank < self.after[0]), write(0, rank))

    def outcode(self, rank: Column) -> Column | None:
        """The rank of the shortest beginning that is a code; None if no code begins another."""
        return rank - F.pmod(rank, F.lit(self.after[self.ends[0]]).cast("long")) if len(self.ends) > 1 else None


def _place(place: Place, s: Column) -> Column:
    """The number of a character or a block's string, which is one of them."""
    if isinstance(place, str):
        return (F.instr(F.lit(place), s) - 1).cast("long")
    table = "|" + "|".join(place)
    return _div((F.instr(F.lit(table), F.concat(F.lit("|"), s)) - 1).cast("long"), 1 + _width(place))


def _div(a: Column, n: int) -> Column:
    """Whole division of longs."""
    return a if n == 1 else F.call_function("div", a, F.lit(n).cast("long"))


def _block(e) -> tuple[str, ...] | None:
    """The strings of an expression in order, if they are few, of one length and without separators."""
    now, done = {"": [e]}, set()
    while now:
        ended = {s for s, es in now.items() if any(map(nullable, es))}
        if ended and (done or len(ended) < len(now)):
            return None
        done |= ended
        nxt: dict[str, list] = {}
        for s, es in now.items():
            for x in es:
                for cs, _, rest in steps(x):
                    if any(c in _SEPARATORS for c in cs):
                        return None
                    for c in cs:
                        nxt.setdefault(s + c, []).append(rest)
        if len(nxt) > MAX_BLOCK:
            return None
        now = nxt
    return tuple(sorted(done)) if len(min(done)) > 1 else None


@functools.cache
def line(regex: str) -> Line | None:
    """The line of a pattern, if it is one."""
    places: list[Place] = []
    ends: list[int] = []
    e = language(regex).tree
    while True:
        if e == EMPTY:
            ends.append(len(places))
            break
        if e[0] == "any" and EMPTY in e[1]:
            rest = [x for x in e[1] if x != EMPTY]
            ends.append(len(places))
            e = rest[0] if len(rest) == 1 else ("any", tuple(rest))
            continue
        head, e = (e[1], e[2]) if e[0] == "seq" else (e, EMPTY)
        if head[0] == "one":
            places.append("".join(sorted(head[1])))
            continue
        block = None if nullable(head) else _block(head)
        if block is None:
            return None
        places.append(block)
    odd = any(isinstance(p, str) and len(p) > 1 and any(s in p for s in _SEPARATORS) for p in places)
    twice = any(a in _SEPARATORS and b in _SEPARATORS for a, b in zip(places, places[1:]))
    last = any(places[e - 1] in _SEPARATORS for e in ends if e)
    if odd or twice or last or not ends or ends[0] == 0 or re.search(r"\\\\", regex):
        return None
    return Line(tuple(places), tuple(ends))
