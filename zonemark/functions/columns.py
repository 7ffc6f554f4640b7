"""International codes as Spark columns.

Codes of the eight compiled formats are read, written and taken apart by built-in expressions; codes of
patterns by Arrow functions over the distinct values of a batch, which only rows of such countries reach.
Literals (fragments, country codes, part names) are folded here, so that a prefix search is two integer
comparisons that a Parquet scan can use.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CA_FIRST, CA_LETTERS, END_TAG, FIRST_PATTERN_TAG, FORMAT_PARTS, FORMAT_TAGS, IE_FIRST, IE_SYMBOLS, UK_AREAS, UK_DISTRICT_LETTERS, UK_UNIT_LETTERS
from ..plans.language import capture_regex, part_names
from ..plans.registry import CodeError, Registry, world_registry
from . import codes
from .codes import MIN_LONG
from .linear import Line, line
from .uk import PARTS as UK_PARTS
from .uk import fold, let, uk_native, uk_part, uk_plain, uk_render

ColumnOrName = Column | str
_PAYLOAD = (1 << 48) - 1


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(text: ColumnOrName) -> Column:
    """Spacing and other scripts' spellings made plain."""
    src, dst = codes.respelling()
    t = F.regexp_replace(F.translate(_col(text), src, dst), r"[ \t\n\r]+", " ")
    return F.trim(F.regexp_replace(t, " *- *", "-"))


# ---- bits -----------------------------------------------------------------------------------------------


def raw(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(MIN_LONG))


def country_bits(key: ColumnOrName) -> Column:
    """The country as an integer: what prefix joins are hashed by."""
    return F.shiftrightunsigned(raw(_col(key)), 54)


def country(key: ColumnOrName) -> Column:
    r = raw(_col(key))
    return F.concat(
        F.chr(F.shiftrightunsigned(r, 59) + 65),
        F.chr(F.shiftrightunsigned(r, 54).bitwiseAND(F.lit(31).cast("long")) + 65),
    )


def tag(key: ColumnOrName) -> Column:
    return F.shiftrightunsigned(raw(_col(key)), 48).bitwiseAND(F.lit(63).cast("long"))


def payload(key: ColumnOrName) -> Column:
    return raw(_col(key)).bitwiseAND(F.lit(_PAYLOAD))


def assemble(cc: Column, tag_: int, payload_: Column) -> Column:
    c = (F.ascii(cc) - 65) * 32 + F.ascii(F.substring(cc, 2, 1)) - 65
    top = F.shiftleft(c.cast("long"), 54).bitwiseOR(F.lit(tag_ << 48))
    return top.bitwiseOR(payload_).bitwiseXOR(F.lit(MIN_LONG))


def _bits(*fields: tuple[Column, int]) -> Column:
    out = F.lit(0).cast("long")
    for c, s in fields:
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), s))
    return out


# ---- reading --------------------------------------------------------------------------------------------


def _fits(t: Column, regex: str) -> Column:
    return t.rlike(rf"^(?:{regex})\z")


def _letter(s: Column) -> Column:
    return F.ascii(s) - 65


def _symbol(s: Column, at: int) -> Column:
    return F.instr(F.lit(IE_SYMBOLS), F.substring(s, at, 1)) - 1


def _gb_rules(v: Column) -> Column:
    """An outcode or a whole postcode whose letters can stand where they do."""
    at = lambda s, m: F.shiftrightunsigned(v, s).bitwiseAND(F.lit(m).cast("long"))
    among = lambda f, letters: F.lit(letters).contains(F.chr(f + 64))
    d1, d2, sector, w1, w2 = at(20, 15), at(14, 63), at(10, 15), at(5, 31), at(0, 31)
    single = at(24, 255).isin([k + 1 for k, a in enumerate(UK_AREAS) if len(a) == 1])
    letter = F.when(d2 < 18, True).when(single, among(d2 - 17, UK_DISTRICT_LETTERS[1])).otherwise(among(d2 - 17, UK_DISTRICT_LETTERS[2]))
    unit = F.when(w1 == 0, sector == 0).otherwise(among(w1, UK_UNIT_LETTERS) & among(w2, UK_UNIT_LETTERS))
    return (d1 > 0) & ~((d1 == 1) & (d2 == 1)) & letter & unit


def _payload_of(name: str, t: Column) -> Column:
    """The payload of a folded text in a compiled format; null if it is no code."""
    if name == "GB":
        return let(uk_native(t, partial=True), lambda v: F.when(_gb_rules(v), v))
    digits = lambda s, at, n: F.substring(s, at, n).cast("long")  # noqa: E731  what the pattern has found to be digits
    alpha = lambda s, at: _letter(F.substring(s, at, 1))
    none = F.lit(0).cast("long")
    if name == "US":
        plus4 = F.when(F.length(t) > 5, digits(t, -4, 4)).otherwise(none)
        return F.when(_fits(t, r"[0-9]{5}(?:[- ]?(?!0000)[0-9]{4})?"), _bits((digits(t, 1, 5), 14)).bitwiseOR(plus4))
    if name == "BR":
        last = F.when(F.length(t) > 5, digits(t, -3, 3) + 1024).otherwise(none)
        return F.when(_fits(t, r"[0-9]{5}(?:-?[0-9]{3})?"), _bits((digits(t, 1, 5), 11)).bitwiseOR(last))
    if name == "FR":
        return F.when(_fits(t, r"[0-9]{5}(?: +CEDEX(?: +[0-9]{0,2})? *)?"), digits(t, 1, 5))
    if name == "CZ":
        return F.when(_fits(t, r"[0-9]{3} ?[0-9]{2}"), digits(t, 1, 3) * 100 + digits(t, -2, 2))
    if name == "LU":
        return F.when(_fits(t, r"(?:L-?)?[0-9]{4}"), digits(t, -4, 4))
    p = F.replace(t, F.lit(" "), F.lit(""))
    if name == "CA":
        low = _bits((F.lit(1), 13), (digits(p, 4, 1), 9), (alpha(p, 5), 4), (digits(p, 6, 1), 0))
        high = _bits((alpha(p, 1), 23), (digits(p, 2, 1), 19), (alpha(p, 3), 14))
        ok = _fits(p, rf"[{CA_FIRST}][0-9][{CA_LETTERS}](?:[0-9][{CA_LETTERS}][0-9])?")
        return F.when(ok, high.bitwiseOR(F.when(F.length(p) > 3, low).otherwise(none)))
    low = _bits((F.lit(1), 20), *[(_symbol(p, k + 4), 15 - 5 * k) for k in range(4)])
    high = _bits(*[(_symbol(p, k + 1), 31 - 5 * k) for k in range(3)])
    ok = _fits(t, rf" *(?:[{IE_FIRST}][0-9][0-9]|D6W) *(?:[{IE_SYMBOLS}]{{4}})? *")
    return F.when(ok, high.bitwiseOR(F.when(F.length(p) > 3, low).otherwise(none)))


def _spellings(t: Column, cc: Column) -> list[Column]:
    """As ``codes.spellings``; a candidate that does not exist is null."""
    own = F.substring(t, 1, 2) == cc
    rest = F.regexp_replace(F.substring(t, 3, 1 << 30), "^[ -]", "")
    out = []
    for b in (t, F.when(own & (rest != ""), rest)):
        out += [b, F.translate(b, " ", "-"), F.translate(b, "-", " "), F.translate(b, " ", ""), F.translate(b, ".", "")]
    return out


def _reader(name: str):
    return lambda s: _payload_of(name, s)


def _first(read, t: Column, cc: Column) -> Column:
    """The payload of the first spelling that is a code; what is written as it should be costs one try."""
    others = F.transform(F.array(*_spellings(t, cc)[1:]), read)
    return F.coalesce(read(t), F.get(F.filter(others, lambda p: p.isNotNull()), F.lit(0)))


def _lines(reg: Registry, countries: list[str] | None) -> dict[tuple[str, int], Line] | None:
    """The lines of all languages that codes of these countries can be stored in, by country and tag; None
    if not all of them are lines."""
    if countries is None:
        return None
    out = {}
    for (cc, v), lang in reg.languages.items():
        if cc in countries:
            out[cc, FIRST_PATTERN_TAG + v - 1] = line(lang.pattern)
    return None if None in out.values() else out


def _by_line(k: Column, lines: dict[tuple[str, int], Line], then) -> Column:
    """``then`` of the line and the payload, by the key's country and tag."""
    out = F.when(F.lit(False), then(next(iter(lines.values())), payload(k)))
    for (cc, t), ln in sorted(lines.items(), key=lambda x: x[0]):
        value = then(ln, payload(k))
        if value is not None:
            out = out.when(F.shiftrightunsigned(raw(k), 48) == (codes.pack_country(cc) << 6 | t), value)
    return out


def _pattern_udf(registry: Registry, what: str):
    """Arrow function over the distinct values of a batch."""

    def parse(cc: pa.Array, text: pa.Array) -> pa.Array:
        seen: dict = {}
        out = []
        for c, t in zip(cc.to_pylist(), text.to_pylist()):
            k = (c, t)
            if k not in seen:
                seen[k] = None if t is None else registry.parse(t, c, bounds=False)
            out.append(seen[k])
        return pa.array(out, pa.int64())

    both = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def span(fragment: pa.Array) -> pa.Array:
        d = fragment.dictionary_encode()
        found = [f and registry.prefix(f) for f in d.dictionary.to_pylist()]
        return pa.array([r and {"lo": r[0], "hi": r[1]} or None for r in found], both).take(d.indices)

    def of_key(fn, kind):
        def run(key: pa.Array) -> pa.Array:
            d = key.dictionary_encode()
            vals = [None if k is None else fn(k) for k in d.dictionary.to_pylist()]
            return pa.array(vals, kind).take(d.indices)

        return run

    match what:
        case "parse":
            return F.arrow_udf(_typed2(parse), "long")
        case "span":
            return F.arrow_udf(_typed1(span), "struct<lo:bigint,hi:bigint>")
        case "text":
            return F.arrow_udf(_typed1(of_key(lambda k: registry.text(k), pa.string())), "string")
        case "outcode":
            return F.arrow_udf(_typed1(of_key(lambda k: registry.outcode(k), pa.int64())), "long")
    raise KeyError(what)


def _typed1(f):
    def run(a: pa.Array) -> pa.Array:
        return f(a)

    return run


def _typed2(f):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return f(a, b)

    return run


@functools.cache
def _literal_country(cc: str) -> str:
    if not (len(cc) == 2 and cc.isascii() and cc.isalpha()):
        raise CodeError(f'"{cc}" is not a two-letter country code')
    return cc.upper()


def _split(code: Column, cc: Column | str | None) -> Column:
    """A struct of the country, or null, and the national part, both folded."""
    return let(tidy(code), lambda t: _split_tidy(t, cc))


def _split_tidy(t: Column, cc: Column | str | None) -> Column:
    both = lambda c, n: F.struct(c.alias("c"), fold(n).alias("t"))
    prefixed = t.rlike("^[A-Za-z]{2}-")
    own, rest = fold(F.substring(t, 1, 2)), F.substring(t, 4, 1 << 30)
    if cc is None:
        return both(F.when(prefixed, own), rest)
    given = F.lit(_literal_country(cc)) if isinstance(cc, str) else F.when(cc.rlike(r"^[A-Za-z]{2}\z"), fold(cc))
    absent = F.lit(False) if isinstance(cc, str) else cc.isNull()
    c = F.when(prefixed, F.when(absent | (own == given), own)).otherwise(given)
    return both(c, F.when(prefixed, rest).otherwise(t))


def to_postal_code(code: ColumnOrName, cc: Column | str | None = None, registry: Registry | None = None, bounds: bool = False) -> Column:
    """The key of a text, or null. ``cc``: a country code as a str, a Column, or None (the text says it).
    With ``bounds`` also the end of a country, written ``CC-~``, which is a bound and no code."""
    reg = registry or world_registry()
    if isinstance(cc, str):
        return _of_one_country(_col(code), _literal_country(cc), reg, bounds)
    names = {reg.format_name(x) for x in reg.countries()}
    own = {n: [x for x in reg.countries() if reg.format_name(x) == n] for n in names}

    def key(x: Column) -> Column:
        c, national = x["c"], x["t"]
        out = F.when((national == "~") & c.isin(reg.countries()), _end(c, bounds))
        for name in [n for n in FORMAT_TAGS if n in names]:
            out = out.when(c.isin(own[name]), assemble(c, FORMAT_TAGS[name], _first(_reader(name), national, c)))
        return out

    # rows that do not plainly name a country of a compiled format are read in Python too
    text, given = _col(code), F.lit(None).cast("string") if cc is None else cc
    plain = fold(F.coalesce(given, F.substring(text, 1, 2))).isin([c for n, x in own.items() if n != "pattern" for c in x])
    parsed = _pattern_udf(reg, "parse")(F.when(~plain, given), F.when(~plain, text))
    return F.coalesce(let(_split(text, cc), key), parsed)


def _end(c: Column, bounds: bool) -> Column:
    return assemble(c, END_TAG, F.lit(0).cast("long")) if bounds else F.lit(None).cast("long")


def _of_one_country(code: Column, cc: str, reg: Registry, bounds: bool) -> Column:
    """Codes of a country that is known: read as they stand first, then tidied and re-spelled."""
    fmt, c = reg.format(cc), F.lit(cc)
    if fmt is None:
        return F.lit(None).cast("long")
    ln = line(fmt.regex) if isinstance(fmt, codes.Patterned) else None
    if isinstance(fmt, codes.Patterned) and ln is None:
        parsed = _pattern_udf(reg, "parse")(c, code)
        if not bounds:
            return parsed
        return F.coalesce(let(_split(code, cc), lambda x: F.when((x["t"] == "~") & (x["c"] == cc), _end(c, True))), parsed)
    read = ln.rank if ln else _reader(fmt.name)
    plain = uk_plain(fold(code), letters=True) if fmt.name == "GB" else read(fold(code))

    def slow(x: Column) -> Column:
        found = assemble(c, fmt.tag, _first(read, x["t"], c))
        return F.when(x["c"] == cc, F.when(x["t"] == "~", _end(c, bounds)).otherwise(found))

    return F.coalesce(assemble(c, fmt.tag, plain), let(_split(code, cc), slow))


def postal_code(code: ColumnOrName, cc: Column | str | None = None, registry: Registry | None = None) -> Column:
    """As to_postal_code, but input that is no code raises an error. For projections, not for filters."""
    text = _col(code)
    fail = F.raise_error(_why(text, cc, registry or world_registry())).cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(to_postal_code(text, cc, registry), fail))


def _why(code: Column, cc: Column | str | None, reg: Registry) -> Column:
    """What is wrong with a text that is no code."""
    given = F.lit(cc).cast("string") if cc is None or isinstance(cc, str) else cc
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def say(t: Column) -> Column:
        prefixed = t.rlike("^[A-Za-z]{2}-")
        own = F.substring(t, 1, 2)
        c = fold(F.when(prefixed, own).otherwise(given))
        compiled = F.when(F.lit(False), F.lit(""))
        for name in FORMAT_TAGS:
            compiled = compiled.when(c.isin([x for x in reg.countries() if reg.format_name(x) == name]), name)
        national = F.when(prefixed, F.substring(t, 4, 1 << 30)).otherwise(t)
        return (
            F.when(given.isNotNull() & ~given.rlike(r"^[A-Za-z]{2}\z"), F.concat(quote(given), F.lit(" is not a two-letter country code")))
            .when(
                prefixed & given.isNotNull() & (fold(own) != fold(given)),
                F.concat(F.lit("country code "), quote(given), F.lit(" does not match the "), quote(F.substring(t, 1, 3)), F.lit(" prefix of "), quote(t)),
            )
            .when(~prefixed & given.isNull(), F.concat(quote(t), F.lit(' has no country: no "CC-" prefix, and no country code was given')))
            .when(~c.isin(reg.countries()), F.concat(quote(c), F.lit(" is not a supported country code")))
            .otherwise(F.concat(F.lit("cannot parse "), quote(national), F.lit(" as a "), F.coalesce(compiled.otherwise(None), c), F.lit(" postal code")))
        )

    return let(tidy(code), say)


def why_not(code: ColumnOrName, cc: Column | str | None = None, registry: Registry | None = None) -> Column:
    """What postal_code would say of a text that is no code; null for codes and nulls."""
    text, reg = _col(code), registry or world_registry()
    return F.when(text.isNotNull() & to_postal_code(text, cc, reg).isNull(), _why(text, cc, reg))


def is_valid_postal_code(code: ColumnOrName, cc: Column | str | None = None, registry: Registry | None = None) -> Column:
    return F.when(_col(code).isNotNull(), to_postal_code(code, cc, registry).isNotNull())


# ---- writing --------------------------------------------------------------------------------------------


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _and(c: Column, m: int) -> Column:
    return c.bitwiseAND(F.lit(m).cast("long"))


def _national(name: str, p: Column) -> Column:
    at = lambda s, m: _and(F.shiftrightunsigned(p, s), m)
    if name == "GB":
        return uk_render(p)
    if name == "US":
        return F.concat(_pad(at(14, (1 << 34) - 1), 5), F.when(_and(p, 16383) > 0, F.concat(F.lit("-"), _pad(_and(p, 16383), 4))).otherwise(""))
    if name == "BR":
        return F.concat(_pad(at(11, (1 << 37) - 1), 5), F.when(_and(p, 1024) > 0, F.concat(F.lit("-"), _pad(_and(p, 1023), 3))).otherwise(""))
    if name == "FR":
        return _pad(p, 5)
    if name == "CZ":
        return F.concat(F.substring(_pad(p, 5), 1, 3), F.lit(" "), F.substring(_pad(p, 5), 4, 2))
    if name == "LU":
        return F.concat(F.lit("L-"), _pad(p, 4))
    if name == "CA":
        alpha = lambda s: F.chr(at(s, 31) + 65)
        dig = lambda s: at(s, 15).cast("string")
        tail = F.concat(F.lit(" "), dig(9), alpha(4), dig(0))
        return F.concat(alpha(23), dig(19), alpha(14), F.when(_and(p, 1 << 13) > 0, tail).otherwise(""))
    sym = lambda s: F.substring(F.lit(IE_SYMBOLS), at(s, 31).cast("int") + 1, F.lit(1))
    tail = F.concat(F.lit(" "), sym(15), sym(10), sym(5), sym(0))
    return F.concat(sym(31), sym(26), sym(21), F.when(_and(p, 1 << 20) > 0, tail).otherwise(""))


def _formats_of(reg: Registry, countries: list[str] | None) -> set[str]:
    return {*FORMAT_TAGS, "pattern"} if countries is None else {reg.format_name(c) for c in countries}


def to_text(key: ColumnOrName, registry: Registry | None = None, countries: list[str] | None = None) -> Column:
    """``CC-code``. ``countries``: those that the column can hold, if known; without a country of a pattern
    among them no Python is used."""
    reg, k = registry or world_registry(), _col(key)
    names = _formats_of(reg, countries)

    def national(k: Column) -> Column:
        t, p = tag(k), payload(k)
        out = F.when(t == END_TAG, F.lit("~"))
        for name in [n for n in FORMAT_TAGS if n in names]:
            out = out.when(t == FORMAT_TAGS[name], _national(name, p))
        return F.concat(country(k), F.lit("-"), out)

    lines = _lines(reg, countries)
    if lines is not None and names - {"pattern"} in ({n} for n in (*FORMAT_TAGS,)) and not lines:
        return national(k)
    out, t = let(k, national), tag(k)
    if lines:
        written = _by_line(k, lines, lambda ln, p: ln.text(p))
        return F.coalesce(F.concat(country(k), F.lit("-"), written), out)
    if "pattern" in names:
        mine = (t >= FIRST_PATTERN_TAG) & (t < END_TAG)
        out = F.when(mine, _pattern_udf(reg, "text")(F.when(mine, k))).otherwise(out)
    return out


def outcode(key: ColumnOrName, registry: Registry | None = None, countries: list[str] | None = None) -> Column:
    """The coarse part of a code as a code; null where a format has none."""
    reg, k = registry or world_registry(), _col(key)
    t, names = tag(k), _formats_of(reg, countries)
    low = lambda s: k.bitwiseAND(F.lit(~((1 << s) - 1)))
    tags = FORMAT_TAGS
    out = F.when(t.isin(tags["US"], tags["CA"], tags["GB"]), low(14)).when(t == tags["BR"], low(11)).when(t == tags["IE"], low(21))
    lines = _lines(reg, countries)
    if lines:
        coarse = _by_line(k, lines, lambda ln, p: ln.outcode(p))
        high = k.bitwiseAND(F.lit(~_PAYLOAD))
        return out.when((t >= FIRST_PATTERN_TAG) & (t < END_TAG), high.bitwiseOR(coarse))
    if "pattern" in names:
        mine = (t >= FIRST_PATTERN_TAG) & (t < END_TAG)
        out = out.when(mine, _pattern_udf(reg, "outcode")(F.when(mine, k)))
    return out


district = outcode


# ---- prefixes -------------------------------------------------------------------------------------------


def lower_bound(fragment: str, registry: Registry | None = None) -> int:
    return (registry or world_registry()).prefix_strict(fragment)[0]


def upper_bound(fragment: str, registry: Registry | None = None) -> int:
    return (registry or world_registry()).prefix_strict(fragment)[1]


def range_literal(lo: int, hi: int) -> Column:
    return F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


def postal_prefix(fragment: str, registry: Registry | None = None) -> Column:
    """[lo, hi) as a struct of two keys."""
    return range_literal(*(registry or world_registry()).prefix_strict(fragment))


def to_postal_prefix(fragment: Column | str, registry: Registry | None = None) -> Column:
    """As postal_prefix; null for what is no fragment. A str is folded, a Column is read row by row."""
    reg = registry or world_registry()
    if isinstance(fragment, str):
        got = reg.prefix(fragment)
        return range_literal(*got) if got else F.lit(None).cast("struct<lo:bigint,hi:bigint>")
    return _pattern_udf(reg, "span")(fragment)


def match(key: ColumnOrName, fragment: Column | str | None, registry: Registry | None = None) -> Column:
    """Does a code begin with a fragment? What is no fragment matches nothing; null gives null."""
    k = _col(key)
    if fragment is None:
        return F.lit(None).cast("boolean")
    if isinstance(fragment, str):
        got = (registry or world_registry()).prefix(fragment)
        if got is None:
            return F.when(k.isNotNull(), F.lit(False))
        return (k >= F.lit(got[0])) & (k < F.lit(got[1]))
    r = to_postal_prefix(fragment, registry)
    return F.when(k.isNotNull() & fragment.isNotNull(), F.coalesce((k >= r["lo"]) & (k < r["hi"]), F.lit(False)))


def not_match(key: ColumnOrName, fragment: Column | str | None, registry: Registry | None = None) -> Column:
    return ~match(key, fragment, registry)


# ---- named parts ----------------------------------------------------------------------------------------


def _patterns(reg: Registry, countries: list[str] | None) -> list[tuple[Column, str]]:
    """(which keys, pattern of their parts)."""
    out = []
    names = _formats_of(reg, countries)
    for name, regex in FORMAT_PARTS.items():
        if name in names:
            out.append((lambda k, n=name: tag(k) == FORMAT_TAGS[n], regex))
    if "pattern" in names:
        for (cc, v), lang in sorted(reg.languages.items()):
            if part_names(lang.pattern) and (countries is None or cc in countries):
                out.append((lambda k, c=cc, t=FIRST_PATTERN_TAG + v - 1: (country_bits(k) == codes.pack_country(c)) & (tag(k) == t), lang.pattern))
    return out


def _read(key: Column, reg: Registry, countries: list[str] | None, then) -> Column:
    """``then`` of a key and its national text, worked out once."""
    text = F.substring(to_text(key, reg, countries), 4, 1 << 30)
    return let(F.struct(key.alias("k"), text.alias("t")), lambda x: then(x["k"], x["t"]))


def _pieces(text: Column, regex: str) -> list[tuple[str, Column]]:
    rx = rf"^(?:{capture_regex(regex)})\z"
    return [(n, F.nullif(F.regexp_extract(text, rx, k + 1), F.lit(""))) for k, n in enumerate(part_names(regex))]


def _having(name: str, reg: Registry, countries: list[str] | None) -> list:
    all_ = _patterns(reg, countries)
    out = [(which, regex) for which, regex in all_ if name in part_names(regex)]
    if not out:
        known = sorted({n for _, r in all_ for n in part_names(r)})
        raise CodeError(f'no postal code here has a part called "{name}"; there are {", ".join(known) or "none"}')
    return out


#: Where the parts of compiled formats stand in a code: first character, how many. GB's are fields of the payload.
_PLACES = {
    "US": {"zip5": (1, 5), "plus4": (7, 4)},
    "CA": {"fsa": (1, 3), "ldu": (5, 3)},
    "IE": {"routing_key": (1, 3), "unique_id": (5, 4)},
    "BR": {"region": (1, 1), "area": (2, 4), "suffix": (7, 3)},
}


def _placed(reg: Registry, countries: list[str] | None) -> list[str] | None:
    """The formats of some countries if all of them are compiled: their parts need no pattern."""
    names = _formats_of(reg, countries)
    return sorted(names - {None}) if countries is not None and "pattern" not in names else None


def _placed_piece(fmt: str, k: Column, name: str) -> tuple[Column, Column]:
    """(a part, where it ends) of a code of a compiled format; null where it is absent."""
    p = payload(k)
    if fmt == "GB":
        lens = [F.length(uk_part(p, n)) + int(n == "sector") for n in UK_PARTS[: UK_PARTS.index(name) + 1]]
        return uk_part(p, name), functools.reduce(lambda x, y: x + y, lens)
    first, n = _PLACES[fmt][name]
    piece = F.nullif(F.substring(_national(fmt, p), first, n), F.lit(""))
    return piece, F.when(piece.isNotNull(), F.lit(first + n - 1))


def _parts_of_format(fmt: str) -> list[str]:
    return list(UK_PARTS) if fmt == "GB" else list(_PLACES.get(fmt, {}))


def part(key: ColumnOrName, name: str, registry: Registry | None = None, countries: list[str] | None = None) -> Column:
    """The named piece of a code's text; null where it is absent."""
    reg = registry or world_registry()
    patterns = _having(name, reg, countries)
    placed = _placed(reg, countries)
    if placed:
        k, out = _col(key), F
        for fmt in (x for x in placed if name in _parts_of_format(x)):
            out = out.when(tag(k) == FORMAT_TAGS[fmt], _placed_piece(fmt, k, name)[0])
        return out

    def pick(k: Column, t: Column) -> Column:
        out = F
        for which, regex in patterns:
            out = out.when(which(k), dict(_pieces(t, regex))[name])
        return out

    return _read(_col(key), reg, countries, pick)


def parts(key: ColumnOrName, registry: Registry | None = None, countries: list[str] | None = None, jsonb_order: bool = False) -> Column:
    """All named pieces as a JSON object, absent ones null; in their order in the code, or by length and
    name with ``jsonb_order``. Null for codes without named parts."""
    reg = registry or world_registry()
    patterns = _patterns(reg, countries)

    def json(pieces: list[tuple[str, Column]]) -> Column:
        if jsonb_order:
            pieces.sort(key=lambda x: (len(x[0]), x[0]))
        return F.to_json(F.struct(*[c.alias(n) for n, c in pieces]), {"ignoreNullFields": "false"})

    def pick(k: Column, t: Column) -> Column:
        out = F.when(tag(k) == END_TAG, F.lit(None).cast("string"))
        for which, regex in patterns:
            out = out.when(which(k), json(_pieces(t, regex)))
        return out

    placed = _placed(reg, countries)
    if placed is None:
        return _read(_col(key), reg, countries, pick)
    k = _col(key)
    out = F.when(tag(k) == END_TAG, F.lit(None).cast("string"))
    for fmt in (x for x in placed if _parts_of_format(x)):
        out = out.when(tag(k) == FORMAT_TAGS[fmt], json([(n, _placed_piece(fmt, k, n)[0]) for n in _parts_of_format(fmt)]))
    return out


def part_end(key: ColumnOrName, name: str, registry: Registry | None = None, countries: list[str] | None = None) -> Column:
    """How many characters of a code (without ``CC-``) go up to the end of a part; null where it is absent."""
    reg = registry or world_registry()
    patterns = _having(name, reg, countries)
    placed = _placed(reg, countries)
    if placed:
        k, out = _col(key), F
        for fmt in (x for x in placed if name in _parts_of_format(x)):
            out = out.when(tag(k) == FORMAT_TAGS[fmt], _placed_piece(fmt, k, name)[1])
        return out

    def pick(k: Column, t: Column) -> Column:
        out = F
        for which, regex in patterns:
            rx, group = _rest_after(regex, name)
            there = F.regexp_extract(t, rx, group) != ""
            out = out.when(which(k) & there, F.length(t) - F.length(F.regexp_extract(t, rx, group + 1)))
        return out

    return _read(_col(key), reg, countries, pick)


def _rest_after(regex: str, name: str) -> tuple[str, int]:
    """A pattern that captures, behind a part's own group, all that follows the part."""
    end = at = regex.index(f"(?<{name}>")
    depth = 0
    while True:
        c = regex[end]
        end += 2 if c == "\\" else regex.index("]", end + 2) + 1 - end if c == "[" else 1
        depth += (c == "(") - (c == ")")
        if not depth:
            break
    group = len(re.findall(r"\(\?<", regex[:at])) + 1
    return rf"^(?:{capture_regex(regex[:end])}(?=(.*)){capture_regex(regex[end:])})\z", group


def prefix_of(key: ColumnOrName, name: str, registry: Registry | None = None, countries: list[str] | None = None) -> Column:
    """The range of the codes that share everything up to and including a part, under the current format."""
    reg, k = registry or world_registry(), _col(key)
    end = part_end(k, name, reg, countries)
    return to_postal_prefix(F.substring(to_text(k, reg, countries), F.lit(1), end + 3), reg)


# ---- country locks --------------------------------------------------------------------------------------

LOCK = "postal_code.country"


def enforce(key: ColumnOrName, cc: str) -> Column:
    """The key, or an error if it is of another country."""
    k, want = _col(key), _literal_country(cc)
    why = F.concat(F.lit('postal code of country "'), country(k), F.lit(f'" does not match the column\'s country "{want}"'))
    ok = k.isNull() | (country_bits(k) == codes.pack_country(want))
    return F.when(ok, k).otherwise(F.raise_error(why).cast("long"))


# ---- binary ---------------------------------------------------------------------------------------------


def send(key: ColumnOrName) -> Column:
    """Eight bytes in network order."""
    return F.unhex(F.lpad(F.hex(raw(_col(key))), 16, "0"))


def receive(data: ColumnOrName) -> Column:
    """The key of eight bytes; null if they are not eight."""
    d = _col(data)
    signed = F.conv(F.hex(d), 16, -10).try_cast("long")
    return F.when(F.octet_length(d) == 8, signed.bitwiseXOR(F.lit(MIN_LONG)))
