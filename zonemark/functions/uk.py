"""UK postcodes as 32-bit values in a long column, and delivery-point suffixes; all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import UK_AREAS, UK_DISTRICT_LETTERS, UK_UNIT_LETTERS
from . import codes
from .codes import UK_SHIFTS

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDE = "".join(f"|{a:<2}." for a in UK_AREAS)
_DISTRICT = "(?!0[0-9] *[0-9][A-Z])[0-9]"
_FULL = r"([A-Z]{1,2})([0-9])(?:([A-Z0-9]?) *([0-9])|([0-9]) +)([A-Z]{2})"
_PARTIAL = _FULL + r"|([A-Z]{1,2})|([A-Z]{1,2})([0-9])([A-Z0-9]?) *|([A-Z]{1,2})([0-9])([A-Z0-9]?) *([0-9])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(text: Column) -> Column:
    """Upper case, ASCII letters only."""
    return F.translate(text, _LOWER, _UPPER)


def _area(s: Column) -> Column:
    """The number of an area, 0 if there is none such."""
    at = F.instr(F.lit(_WIDE), F.concat(F.lit("|"), F.rpad(s, 2, " "), F.lit(".")))
    return F.when(s == "", 0).otherwise(F.floor((at + 3) / 4))


def _digit(s: Column) -> Column:
    return F.when(s == "", 0).otherwise(F.ascii(s) - 47)


def _packed(*fields: Column) -> Column:
    out = F.lit(0).cast("long")
    for f, s in zip(fields, UK_SHIFTS):
        out = out.bitwiseOR(F.shiftleft(f.cast("long"), s))
    return out


def uk_native(t: Column, partial: bool) -> Column:
    """The value of a folded text, or null.

    One pass of the grammar writes the fields out between bars: area, district 1 and 2, sector, walk."""
    regex, fields = (_PARTIAL, "$1$7$8$11|$2$9$12|$3$10$13|$4$5$14|$6") if partial else (_FULL, "$1|$2|$3|$4$5|$6")
    found = F.when((F.length(t) <= 32) & ~t.contains("|"), F.split(F.regexp_replace(t, rf"^(?:{regex})\z", fields), r"\|"))

    def value(g: Column) -> Column:
        walk = [F.when(g[4] == "", 0).otherwise(F.ascii(F.substring(g[4], k, 1)) - 64) for k in (1, 2)]
        bad = (g[3] != "") & (g[1] == "0") & (g[2] != "") & (g[2] <= "9")
        area = _area(g[0])
        return F.when((F.size(g) == 5) & ~bad & (area > 0), _packed(area, _digit(g[1]), _digit(g[2]), _digit(g[3]), *walk))

    return let(found, value)


def uk_plain(t: Column, letters: bool = False) -> Column:
    """The value of a folded text that is a whole postcode written as usual, an outcode, spaces and three
    characters; null for all else, also for other spellings. With ``letters`` only where letters can stand.

    In bare column expressions, so that all of it is generated code."""
    if letters:
        one, two = (f"[0-9{UK_DISTRICT_LETTERS[k]}]?" for k in (1, 2))
        ok = t.rlike(rf"^(?:[A-Z]{_DISTRICT}{one}|[A-Z]{{2}}{_DISTRICT}{two}) *[0-9][{UK_UNIT_LETTERS}]{{2}}\z")
    else:
        ok = t.rlike(rf"^[A-Z]{{1,2}}{_DISTRICT}[A-Z0-9]? *[0-9][A-Z]{{2}}\z")
    wide = F.substring(t, 2, 1) >= "A"
    area = _area(F.when(wide, F.substring(t, 1, 2)).otherwise(F.substring(t, 1, 1)))
    out = F.rtrim(F.substring(t, F.lit(1), F.length(t) - 3))
    d1, d2 = (F.substring(out, F.when(wide, 3 + k).otherwise(2 + k), F.lit(1)) for k in (0, 1))
    last = [F.ascii(F.substring(t, k, 1)) - 64 for k in (-2, -1)]
    return F.when(ok & (F.length(t) <= 32) & (area > 0), _packed(area, _digit(d1), _digit(d2), _digit(F.substring(t, -3, 1)), *last))


def uk_parse(text: Column, partial: bool = False) -> Column:
    """A UK postcode, or with ``partial`` a part of one; null if it is none."""
    return F.coalesce(uk_plain(fold(text)), uk_native(fold(text), partial))


def uk_cast(text: Column) -> Column:
    """As uk_parse for whole postcodes, but other text is an error. For projections, not for filters."""
    fail = F.raise_error(F.lit("cannot parse input for type postcode")).cast("long")
    return F.when(text.isNotNull(), F.coalesce(uk_parse(text), fail))


def uk_validate(text: Column) -> Column:
    return F.when(text.isNotNull(), uk_parse(text).isNotNull())


def uk_field(v: Column, k: int) -> Column:
    return F.shiftrightunsigned(v, UK_SHIFTS[k]).bitwiseAND(F.lit((255, 15, 63, 15, 31, 31)[k]).cast("long"))


def _shown(v: Column, k: int) -> Column:
    f = uk_field(v, k)
    if k == 0:
        area = F.trim(F.substring(F.lit(_WIDE), ((f - 1) * 4 + 2).cast("int"), F.lit(2)))
        return F.when((f >= 1) & (f <= len(UK_AREAS)), area).when(f.isNotNull(), "?")
    base, top = (64, 27) if k > 3 else (47, 11)
    ok = (f <= top) if k != 2 else ((f <= top) | ((f >= 18) & (f <= 44)))
    return F.when(f == 0, "").when(ok, F.chr(f + base)).when(f.isNotNull(), "?")


def uk_render(v: Column) -> Column:
    """Canonical text; a field that cannot be shown is a question mark."""
    sector = _shown(v, 3)
    return F.concat(_shown(v, 0), _shown(v, 1), _shown(v, 2), F.when(sector != "", F.lit(" ")).otherwise(""), sector, _shown(v, 4), _shown(v, 5))


def uk_bits_ok(v: Column) -> Column:
    """Whether every field can be shown; one past the last digit or letter is let through, for bounds."""
    f = [uk_field(v, k) for k in range(6)]
    fine = f[0].between(1, len(UK_AREAS)) & (f[1] <= 11) & ((f[2] <= 11) | f[2].between(18, 44)) & (f[3] <= 11) & (f[4] <= 27) & (f[5] <= 27)
    return fine & (F.shiftrightunsigned(v, 32) == 0)


def uk_to_text(v: Column) -> Column:
    """Canonical text; null if the bits are no postcode's."""
    return F.when(uk_bits_ok(v), uk_render(v))


def uk_show(v: Column) -> Column:
    """As uk_to_text, but bits that are no postcode's are an error."""
    return F.when(v.isNotNull(), F.coalesce(uk_to_text(v), F.raise_error(F.lit("cannot render corrupted binary data to text")).cast("string")))


# ---- fragments ------------------------------------------------------------------------------------------


def _free(fragment: int) -> int:
    """The number of low bits below a fragment's last field."""
    f = codes.uk_unpack(fragment)
    return 0 if f[4] else 10 if f[3] else 14 if f[1] else 24


def _free_col(v: Column) -> Column:
    return F.when(uk_field(v, 4) > 0, 0).when(uk_field(v, 3) > 0, 10).when(uk_field(v, 1) > 0, 14).otherwise(24)


def uk_match(v: Column, fragment: Column | str) -> Column:
    """Is a postcode inside a fragment? What is no fragment holds nothing; null gives null."""
    if isinstance(fragment, str):
        f = codes.uk_fields(fragment, True)
        if f is None:
            return F.when(v.isNotNull(), F.lit(False))
        lo = codes.uk_pack(f)
        return (v >= F.lit(lo).cast("long")) & (v < F.lit(lo + (1 << _free(lo))).cast("long"))
    f = uk_parse(fragment, True)
    same = F.call_function("shiftrightunsigned", v, _free_col(f)) == F.call_function("shiftrightunsigned", f, _free_col(f))
    return F.when(v.isNotNull() & fragment.isNotNull(), F.coalesce(same, F.lit(False)))


def uk_not_match(v: Column, fragment: Column | str) -> Column:
    return ~uk_match(v, fragment)


def uk_cmp_partial(v: Column, fragment: Column) -> Column:
    """-1, 0 or 1 by the fragment's level; what is no fragment is above everything."""
    f = uk_parse(fragment, True)
    a = F.call_function("shiftrightunsigned", v, _free_col(f))
    b = F.call_function("shiftrightunsigned", f, _free_col(f))
    out = F.coalesce(F.when(a < b, -1).when(a > b, 1).when(a == b, 0), F.lit(-1))
    return F.when(v.isNotNull() & fragment.isNotNull(), out)


def uk_range_lower(fragment: str) -> int:
    f = codes.uk_fields(fragment, True)
    if f is None:
        raise ValueError("invalid postcode prefix")
    return codes.uk_pack(f)


def uk_range_upper(fragment: str) -> int:
    """The value after all that begin with a fragment, its absent fields filled with their least values."""
    lo = uk_range_lower(fragment)
    v = lo + (1 << _free(lo))
    area, d1, d2, sector, w1, w2 = codes.uk_unpack(v)
    return codes.uk_pack((area, d1 or 1, d2, sector or 1, w1 or 1, w2 or 1))


# ---- parts ----------------------------------------------------------------------------------------------

PARTS = ("area", "district", "sector", "walk")


def uk_part(v: Column, name: str) -> Column:
    """A named part of a valid value; null where it is absent."""
    if name not in PARTS:
        raise ValueError(f'postcodes have no part called "{name}"; they have {", ".join(PARTS)}')
    out = {
        "area": _shown(v, 0),
        "district": F.concat(_shown(v, 1), _shown(v, 2)),
        "sector": _shown(v, 3),
        "walk": F.concat(_shown(v, 4), _shown(v, 5)),
    }[name]
    return F.when(uk_bits_ok(v) & (out != ""), out)


def uk_parts(v: Column, jsonb_order: bool = False) -> Column:
    order = sorted(PARTS, key=lambda n: (len(n), n)) if jsonb_order else PARTS
    return F.when(uk_bits_ok(v), F.to_json(F.named_struct(*[x for n in order for x in (F.lit(n), uk_part(v, n))]), {"ignoreNullFields": "false"}))


def uk_prefix_of(v: Column, name: str) -> Column:
    """The text up to and including a part, to match with."""
    upto = PARTS[: PARTS.index(name) + 1]
    pieces = [F.concat(F.lit(" "), uk_part(v, n)) if n == "sector" else uk_part(v, n) for n in upto]
    return F.concat(*pieces)


def uk_to_char(v: Column, template: str) -> Column:
    """A, D, S and W stand for the fields, other characters for themselves."""
    fields = {"A": _shown(v, 0), "D": F.concat(_shown(v, 1), _shown(v, 2)), "S": _shown(v, 3), "W": F.concat(_shown(v, 4), _shown(v, 5))}
    return F.concat(F.lit(""), *[fields.get(c, F.lit(c)) for c in template])


def uk_send(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v), 8, "0"))


def uk_receive(data: Column) -> Column:
    v = F.conv(F.hex(data), 16, 10).try_cast("long")
    return F.when((F.octet_length(data) == 4) & uk_bits_ok(v), v)


# ---- delivery-point suffixes ----------------------------------------------------------------------------


def dps_parse(text: Column) -> Column:
    """1 to 180 in text order: a digit 1 to 9 and a letter; null if it is none."""
    t = fold(text)
    ok = t.rlike(rf"^[1-9][{UK_UNIT_LETTERS}]\z")
    n = (F.ascii(t) - 49) * len(UK_UNIT_LETTERS) + F.instr(F.lit(UK_UNIT_LETTERS), F.substring(t, 2, 1))
    return F.when(ok, n.cast("short"))


def dps_cast(text: Column) -> Column:
    fail = F.raise_error(F.lit("cannot parse input for type dps")).cast("short")
    return F.when(text.isNotNull(), F.coalesce(dps_parse(text), fail))


def dps_validate(text: Column) -> Column:
    return F.when(text.isNotNull(), dps_parse(text).isNotNull())


def dps_to_text(v: Column) -> Column:
    n = len(UK_UNIT_LETTERS)
    k = v.cast("int") - 1
    out = F.concat(F.chr((F.floor(k / n) + 49)), F.substring(F.lit(UK_UNIT_LETTERS), F.pmod(k, F.lit(n)) + 1, F.lit(1)))
    return F.when(v.between(1, 9 * n), out)


def dps_send(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0"))


def dps_receive(data: Column) -> Column:
    v = F.conv(F.hex(data), 16, 10).try_cast("short")
    return F.when((F.octet_length(data) == 1) & v.between(1, 9 * len(UK_UNIT_LETTERS)), v)
