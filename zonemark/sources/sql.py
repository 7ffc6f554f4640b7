"""The functions under SQL names, for spark.sql.

What the column functions express without Python is registered as SQL functions, whose bodies are the
column expressions' own SQL: Spark inlines them, folds literals and pushes what is left to the scan, so
``WHERE postal_code_partial(key, 'US-902')`` is two bounds on the key.  Only what needs a country's pattern
or another spelling goes through Arrow functions, which see nulls for all other rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..fixed import END_TAG, FIRST_PATTERN_TAG, FORMAT_TAGS
from ..functions import codes, ranges, uk
from ..functions import columns as C
from ..functions.linear import line
from ..plans.language import part_names, parts_check, resolve, same_codes
from ..plans.registry import Registry, world_registry

_RANGE = "STRUCT<lo: BIGINT, hi: BIGINT>"
_HIGH, _LOW = "9223372036854775807L", "(-9223372036854775807L - 1L)"


def sql_of(spark: SparkSession, column: Column, args: str) -> str:
    """The SQL text of an expression over the arguments ``args`` (name type, ...)."""
    df = spark.createDataFrame([], args).select(column.alias("_"))
    out = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
    said = "raise_error('USER_RAISED_EXCEPTION', map('errorMessage', "
    while said in out:  # what SQL itself says with one argument
        at = out.index(said)
        end = _closed(out, at + len(said))
        out = f"{out[:at]}raise_error({out[at + len(said) : end]}){out[end + 2 :]}"
    return out


def _closed(text: str, at: int) -> int:
    """Where the bracket closes that is open at a place; quoted text does not count."""
    depth, quoted = 1, False
    while True:
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != "'"
        elif c == "'":
            quoted = True
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                return at
        at += 1


@functools.cache
def _national_bodies() -> dict[str, Column]:
    """Payloads of a folded text ``t`` that is written as it should be, by compiled format."""
    t = F.col("t")
    return {n: uk.uk_plain(t, letters=True) if n == "GB" else C._payload_of(n, t) for n in FORMAT_TAGS}


def _digit_runs(reg: Registry) -> dict[str, tuple[int, int, int, int]]:
    """Countries whose codes begin with digits: (how many, codes below each, the first code's number, the
    key of number 0)."""
    plain = {"US": (5, 1 << 14), "BR": (5, 1 << 11), "FR": (5, 1), "CZ": (5, 1)}
    out = {}
    for cc in reg.countries():
        fmt = reg.format(cc)
        if fmt.name in plain:
            n, unit, base = *plain[fmt.name], 0
        else:
            ln = line(fmt.regex) if isinstance(fmt, codes.Patterned) else None
            n = 0
            while ln and n < ln.ends[0] and (ln.places[n] == "0123456789" or (not n and ln.places[n] == "123456789")):
                n += 1
            if not n:
                continue
            unit, base = ln.after[n], 10 ** (n - 1) if ln.places[0] == "123456789" else 0
        out[cc] = (n, unit, base, codes.assemble(cc, fmt.tag, 0))
    return out


def _per_value(fn, kind: pa.DataType):
    """An Arrow function that calls ``fn`` once for each distinct row of a batch."""

    def of(cols: list[pa.Array]) -> pa.Array:
        seen: dict = {}
        out = []
        for row in zip(*(c.to_pylist() for c in cols)):
            if row not in seen:
                seen[row] = fn(*row)
            out.append(seen[row])
        return pa.array(out, kind)

    return of


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Make the functions available in a session; returns their names. Once is enough for a registry."""
    reg = registry or world_registry()
    before = getattr(spark, "_zonemark_names", None)
    if before and before[0] is reg:
        return before[1]
    names: list[str] = []

    def python(name: str, fn, kind: pa.DataType, sql: str, nulls: tuple[bool, ...] = (True,)) -> None:
        """An Arrow function; nulls: which arguments give null if they are null."""
        call = _per_value(lambda *a: None if any(x is None and n for x, n in zip(a, nulls)) else fn(*a), kind)
        if len(nulls) == 1:

            def run(a: pa.Array) -> pa.Array:
                return call([a])

        else:

            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return call([a, b])

        spark.udf.register(name, F.arrow_udf(run, sql))
        names.append(name)

    def sql(name: str, args: str, returns: str, body: Column | str) -> None:
        if not isinstance(body, str):
            body = sql_of(spark, body, args.replace(" DEFAULT NULL", ""))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
        names.append(name)

    text, key, flag = (pa.string(), "string"), (pa.int64(), "bigint"), (pa.bool_(), "boolean")
    bounds = (pa.struct([("lo", pa.int64()), ("hi", pa.int64())]), "struct<lo:bigint,hi:bigint>")
    as_struct = lambda r: r and {"lo": r[0], "hi": r[1]}
    k, t, v = F.col("k"), F.col("t"), F.col("v")

    # ---- codes: written as they should be, without Python
    sql("country", "k BIGINT", "STRING", C.country("k"))
    sql("postal_country", "k BIGINT", "STRING", "country(k)")
    native = F.when(F.lit(False), F.lit(None).cast("long"))
    for name, payload in _national_bodies().items():
        own = [x for x in reg.countries() if reg.format_name(x) == name]
        native = native.when(F.col("cc").isin(own), C.assemble(F.col("cc"), FORMAT_TAGS[name], payload)) if own else native
    sql("_postal_native", "t STRING, cc STRING", "BIGINT", native)
    python("_postal_parse", lambda c, cc: reg.parse(c, cc, bounds=False), *key, (True, False))
    python("_postal_strict", reg.parse_strict, *key, (True, False))
    fold = sql_of(spark, uk.fold(t), "t STRING")
    folded = f"_postal_native({fold}, {sql_of(spark, uk.fold(F.col('cc')), 'cc STRING')})"
    for name, slow in (("to_postal_code", "_postal_parse"), ("postal_code", "_postal_strict")):
        # what is passed on as an argument is worked out once
        sql(f"{slow}_rest", "n BIGINT, t STRING, cc STRING", "BIGINT", f"coalesce(n, {slow}(CASE WHEN n IS NULL THEN t END, cc))")
        sql(name, "t STRING, cc STRING DEFAULT NULL", "BIGINT", f"{slow}_rest({folded}, t, cc)")
    sql("is_valid_postal_code", "t STRING, cc STRING DEFAULT NULL", "BOOLEAN", "CASE WHEN t IS NOT NULL THEN to_postal_code(t, cc) IS NOT NULL END")
    python("_postal_text", reg.text, *text)
    shown = F.when(C.tag(k) == END_TAG, F.lit("~"))
    for name, tag in FORMAT_TAGS.items():
        shown = shown.when(C.tag(k) == tag, C._national(name, C.payload(k)))
    sql("postal_text", "k BIGINT", "STRING", f"coalesce({sql_of(spark, F.concat(C.country(k), F.lit('-'), shown), 'k BIGINT')}, _postal_text(CASE WHEN {_tag(spark)} THEN k END))")
    python("_postal_outcode", reg.outcode, *key)
    compiled = sql_of(spark, C.outcode(k, reg, countries=[c for c in reg.countries() if reg.format_name(c) != "pattern"]), "k BIGINT")
    sql("outcode", "k BIGINT", "BIGINT", f"CASE WHEN {_tag(spark)} THEN _postal_outcode(CASE WHEN {_tag(spark)} THEN k END) ELSE {compiled} END")
    sql("district", "k BIGINT", "BIGINT", "outcode(k)")
    python("tidy", codes.tidy, *text)

    # ---- fragments: digits and GB ones without Python, and so folded if they are literals
    runs = _digit_runs(reg)
    # one literal, which is folded to a map: how many digits, codes below each, the first number, the key of number 0
    table = ",".join(f"{cc}={'/'.join(map(str, x))}" for cc, x in runs.items())
    found = f"CAST(split(str_to_map('{table}', ',', '=')[substr(f, 1, 2)], '/') AS ARRAY<BIGINT>)"
    sql("_postal_run", "f STRING", "ARRAY<BIGINT>", f"CASE WHEN f RLIKE '^[A-Z][A-Z]-[0-9]+$' THEN {found} END")
    args = "f STRING, r ARRAY<BIGINT>"
    number = lambda plus: f"((CAST(substr(f, 4) AS BIGINT) + {plus}) * CAST(pow(10, r[0] - length(f) + 3) AS BIGINT) - r[2])"
    end = sql_of(spark, C.assemble(F.substring("f", 1, 2), END_TAG, F.lit(0).cast("long")), "f STRING")
    fits = "length(f) - 3 <= r[0] AND (r[2] = 0 OR substr(f, 4, 1) <> '0')"
    first = f"CASE WHEN {fits} THEN r[3] + {number(0)} * r[1] END"
    after = f"CASE WHEN {fits} THEN CASE WHEN {number(1)} = CAST(pow(10, r[0]) AS BIGINT) - r[2] THEN {end} ELSE r[3] + {number(1)} * r[1] END END"
    sql("_postal_run_first", args, "BIGINT", first)
    sql("_postal_run_after", args, "BIGINT", after)
    sql("_postal_run_lower", "f STRING", "BIGINT", "_postal_run_first(f, _postal_run(f))")
    sql("_postal_run_upper", "f STRING", "BIGINT", "_postal_run_after(f, _postal_run(f))")
    british = [c for c in reg.countries() if reg.format_name(c) == "GB"]
    whole, area = uk.uk_plain(F.substring("f", F.lit(4), F.length("f")), letters=True), uk._area(F.substring("f", F.lit(4), F.length("f")))
    is_area, mine = F.col("f").rlike("^[A-Z]{2}-[A-Z]{1,2}$"), F.substring("f", 1, 2).isin(british)
    at = lambda x: C.assemble(F.substring("f", 1, 2), FORMAT_TAGS["GB"], x)
    sql("_postal_uk_lower", "f STRING", "BIGINT", F.when(mine, F.when(is_area & (area > 0), at(F.shiftleft(area.cast("long"), 24))).when(~is_area, at(whole))))
    sql("_postal_uk_upper", "f STRING", "BIGINT", F.when(mine, F.when(is_area & (area > 0), at(F.shiftleft((area + 1).cast("long"), 24))).when(~is_area, at(whole) + 1)))
    python("_postal_span", lambda f: as_struct(reg.prefix(f)), *bounds)
    python("_postal_span_strict", lambda f: as_struct(reg.prefix_strict(f)), *bounds)
    rest = "CASE WHEN _postal_run_lower(f) IS NULL THEN f END"
    for side, name in (("lo", "lower"), ("hi", "upper")):
        sql(f"_postal_{side}_strict", "r BIGINT, f STRING", "BIGINT", f"coalesce(r, _postal_span_strict(CASE WHEN r IS NULL THEN f END).{side})")
        sql(f"{name}_bound", "f STRING", "BIGINT", f"_postal_{side}_strict(_postal_run_{name}(f), f)")
        # what is no fragment has bounds that hold nothing
        none = _HIGH if side == "lo" else _LOW
        least = "CASE WHEN r IS NULL AND u IS NULL THEN f END"
        sql(f"_postal_{side}_of", "r BIGINT, u BIGINT, f STRING", "BIGINT", f"coalesce(r, u, _postal_span({least}).{side}, CASE WHEN f IS NOT NULL THEN {none} END)")
        sql(f"_postal_{side}", "f STRING", "BIGINT", f"_postal_{side}_of(_postal_run_{name}(f), _postal_uk_{name}(f), f)")
    for name in ("postal_code_partial", "postal_match"):
        sql(name, "k BIGINT, f STRING", "BOOLEAN", "k >= _postal_lo(f) AND k < _postal_hi(f)")
    for name in ("postal_code_not_partial", "postal_not_match"):
        sql(name, "k BIGINT, f STRING", "BOOLEAN", "NOT postal_code_partial(k, f)")
    sql("postal_prefix", "f STRING", _RANGE, "CASE WHEN f IS NOT NULL THEN named_struct('lo', lower_bound(f), 'hi', upper_bound(f)) END")
    run = "named_struct('lo', _postal_run_lower(f), 'hi', _postal_run_upper(f))"
    sql("to_postal_prefix", "f STRING", _RANGE, f"CASE WHEN _postal_run_lower(f) IS NOT NULL THEN {run} ELSE _postal_span({rest}) END")

    # ---- patterns and named parts
    python("postal_code_pattern_check", resolve, *text)
    python("postal_code_pattern_size", _size, *key)
    python("postal_code_same_codes", lambda a, b: same_codes(_regex(a), _regex(b)), *flag, (True, True))
    python("postal_code_pattern_part_names", lambda p: part_names(_regex(p)), pa.list_(pa.string()), "array<string>")
    python("postal_code_parts_check", lambda p: parts_check(_regex(p)), *text)
    to_json = lambda p: p if p is None else json.dumps(p, separators=(",", ":"))
    for name in ("part", "postal_part"):
        python(name, reg.part, *text, (True, True))
    for name in ("parts", "postal_parts"):
        python(name, lambda k: to_json(reg.parts(k)), *text)
    python("postal_code_part_end", reg.part_end, *key, (True, True))
    sql("prefix_of", "k BIGINT, name STRING", _RANGE, "to_postal_prefix(substr(postal_text(k), 1, CAST(postal_code_part_end(k, name) AS INT) + 3))")
    sql("postal_code_send", "k BIGINT", "BINARY", C.send(k))
    sql("postal_code_recv", "b BINARY", "BIGINT", C.receive("b"))
    why = "concat('postal code of country \"', country(k), '\" does not match the column\\'s country \"', upper(cc), '\"')"
    sql("postal_code_enforce", "k BIGINT, cc STRING", "BIGINT", f"CASE WHEN k IS NULL OR country(k) = upper(cc) THEN k ELSE CAST(raise_error({why}) AS BIGINT) END")
    for name, fn in (
        ("contains", ranges.contains_range), ("overlaps", ranges.overlaps), ("adjacent", ranges.adjacent), ("before", ranges.before), ("after", ranges.after),
        ("not_right_of", ranges.not_right_of), ("not_left_of", ranges.not_left_of), ("equals", ranges.equals), ("intersection", ranges.intersection),
        ("union", ranges.union), ("merge", ranges.merge), ("difference", ranges.difference),
    ):
        kind = _RANGE if name in ("intersection", "union", "merge", "difference") else "BOOLEAN"
        sql(f"postal_range_{name}", f"a {_RANGE}, b {_RANGE}", kind, fn(F.col("a"), F.col("b")))
    sql("postal_range_contains_code", f"a {_RANGE}, k BIGINT", "BOOLEAN", ranges.contains(F.col("a"), k))
    sql("postal_range_isempty", f"a {_RANGE}", "BOOLEAN", ranges.isempty(F.col("a")))

    # ---- UK postcodes and delivery-point suffixes
    python("_uk_read", lambda x: (lambda f: codes.uk_pack(f) if f else None)(codes.uk_fields(x, False)), *key)
    python("_uk_fragment", lambda x: (lambda f: codes.uk_pack(f) if f else None)(codes.uk_fields(x, True)), *key)
    quick = sql_of(spark, uk.uk_plain(uk.fold(t)), "t STRING")
    for name, slow in (("text_to_postcode", "_uk_read"), ("postcode_fragment", "_uk_fragment")):
        sql(f"{slow}_rest", "n BIGINT, t STRING", "BIGINT", f"coalesce(n, {slow}(CASE WHEN n IS NULL THEN t END))")
        sql(name, "t STRING", "BIGINT", f"{slow}_rest({quick}, t)")
    sql("uk_postcode", "t STRING", "BIGINT", "text_to_postcode(t)")
    sql("postcode_validate", "t STRING", "BOOLEAN", "CASE WHEN t IS NOT NULL THEN text_to_postcode(t) IS NOT NULL END")
    sql("postcode_to_text", "v BIGINT", "STRING", uk.uk_show(v))
    sql("uk_text", "v BIGINT", "STRING", uk.uk_to_text(v))
    sql("postcode_send", "v BIGINT", "BINARY", uk.uk_send(v))
    sql("postcode_recv", "b BINARY", "BIGINT", uk.uk_receive(F.col("b")))
    sql("_uk_free", "v BIGINT", "INT", uk._free_col(v))
    same = "shiftrightunsigned(v, _uk_free(postcode_fragment(f))) = shiftrightunsigned(postcode_fragment(f), _uk_free(postcode_fragment(f)))"
    sql("postcode_eq_partial", "v BIGINT, f STRING", "BOOLEAN", f"CASE WHEN v IS NOT NULL AND f IS NOT NULL THEN coalesce({same}, false) END")
    sql("postcode_ne_partial", "v BIGINT, f STRING", "BOOLEAN", "NOT postcode_eq_partial(v, f)")
    above = same.replace(" = ", " {} ")
    cmp = f"coalesce(CASE WHEN {above.format('<')} THEN -1 WHEN {above.format('>')} THEN 1 WHEN {above.format('=')} THEN 0 END, -1)"
    sql("postcode_cmp_partial", "v BIGINT, f STRING", "INT", f"CASE WHEN v IS NOT NULL AND f IS NOT NULL THEN {cmp} END")
    python("range_lower", uk.uk_range_lower, *key)
    python("range_upper", uk.uk_range_upper, *key)
    piece = {n: sql_of(spark, uk.uk_part(v, n), "v BIGINT") for n in uk.PARTS}
    which = " ".join(f"WHEN '{n}' THEN {x}" for n, x in piece.items())
    sql("uk_part", "v BIGINT, name STRING", "STRING", f"CASE name {which} ELSE CAST(raise_error(concat('postcodes have no part called ', name)) AS STRING) END")
    sql("uk_parts", "v BIGINT", "STRING", uk.uk_parts(v))
    which = " ".join(f"WHEN '{n}' THEN {sql_of(spark, uk.uk_prefix_of(v, n), 'v BIGINT')}" for n in uk.PARTS)
    sql("uk_prefix_of", "v BIGINT, name STRING", "STRING", f"CASE name {which} ELSE CAST(raise_error(concat('postcodes have no part called ', name)) AS STRING) END")
    field = {c: sql_of(spark, uk.uk_to_char(v, c), "v BIGINT") for c in "ADSW"}
    which = " ".join(f"WHEN '{c}' THEN {x}" for c, x in field.items())
    sql("uk_to_char", "v BIGINT, template STRING", "STRING", f"array_join(transform(split(template, ''), c -> CASE c {which} ELSE c END), '')")
    sql("postcode_version", "", "STRING", f"'{__version__}'")
    sql("text_to_dps", "t STRING", "SMALLINT", uk.dps_parse(t))
    sql("dps_validate", "t STRING", "BOOLEAN", uk.dps_validate(t))
    sql("dps_to_text", "d SMALLINT", "STRING", uk.dps_to_text(F.col("d")))
    sql("dps_send", "d SMALLINT", "BINARY", uk.dps_send(F.col("d")))
    sql("dps_recv", "b BINARY", "SMALLINT", uk.dps_receive(F.col("b")))

    @F.udtf(returnType="ord int, name string, piece string")
    class PartsOf:
        def eval(self, k: int) -> Iterator[tuple[int, str, str | None]]:
            for n, (name, piece) in enumerate((reg.parts(k) or {}).items() if k is not None else ()):
                yield n + 1, name, piece

    spark.udtf.register("parts_of", PartsOf)
    names.append("parts_of")
    for view, frame in (
        ("postal_code_formats", reg.formats_frame(spark)),
        ("postal_code_languages", reg.languages_frame(spark)),
        ("postal_code_country_formats", reg.country_formats(spark)),
        ("postal_code_parts", reg.parts_frame(spark)),
        ("postal_code_world", reg.world(spark)),
    ):
        frame.createOrReplaceTempView(view)
    spark._zonemark_names = (reg, names)
    return names


def _tag(spark: SparkSession) -> str:
    """Whether a key is of a pattern."""
    t = C.tag("k")
    return sql_of(spark, (t >= FIRST_PATTERN_TAG) & (t < END_TAG), "k BIGINT")


def _regex(p: str) -> str:
    return resolve(p) if p.startswith("/") else p


def _size(p: str) -> int:
    from ..plans.language import language

    return language(resolve(p)).size
