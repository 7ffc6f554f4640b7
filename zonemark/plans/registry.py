"""Which country writes its codes how: immutable snapshots.

A registry never changes; each change gives a new one, with the next number.  Columns are built against
one registry and stay with it, so a query sees one state of the world.  A language, once given, is
permanent: stored codes are read back with it.
"""

from __future__ import annotations

import functools
import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed import BASIS, COMPILED_COUNTRIES, END_TAG, FIRST_PATTERN_TAG, FORMAT_PARTS, FORMATS, MAX_VERSION, NAMED_PATTERNS, PATTERNS
from ..functions import codes
from .language import capture_regex, language, part_names, parts_check, resolve, same_codes


@dataclass(frozen=True)
class Language:
    iso2: str
    version: int
    source: str
    pattern: str
    builtin: bool
    created_at: datetime | None = None


class CodeError(ValueError):
    """Input that is no code, with the reason."""


@dataclass(frozen=True)
class Registry:
    builtin: dict[str, str]
    languages: dict[tuple[str, int], Language]
    user: dict[str, tuple[str | None, datetime]] = field(default_factory=dict)
    snapshot: int = 0

    # ---- lookups ----------------------------------------------------------------------------------------

    def format_name(self, cc: str) -> str | None:
        return self.user[cc][0] if cc in self.user else self.builtin.get(cc)

    def countries(self) -> list[str]:
        return sorted(c for c in {*self.builtin, *self.user} if self.format_name(c))

    def version(self, cc: str) -> int:
        return max((v for c, v in self.languages if c == cc), default=0)

    def format(self, cc: str) -> codes.Format | None:
        """The format in which new codes of a country are stored."""
        name = self.format_name(cc)
        if name is None:
            return None
        if name != "pattern":
            return codes.COMPILED[name]
        v = self.version(cc)
        return codes.pattern_format(v, self.languages[cc, v].pattern)

    def format_of(self, key: int) -> codes.Format | None:
        """The format that a key was stored in."""
        tag, cc = codes.tag_of(key), codes.country_of(key)
        if tag in codes.BY_TAG:
            return codes.BY_TAG[tag]
        lang = self.languages.get((cc, tag - FIRST_PATTERN_TAG + 1))
        return codes.pattern_format(lang.version, lang.pattern) if lang else None

    # ---- codes ------------------------------------------------------------------------------------------

    def parse(self, code: str, cc: str | None = None, bounds: bool = True) -> int | None:
        """The key of a text, or None; with ``bounds`` also of a country's end, written ``CC-~``."""
        country, national = codes.split_country(codes.tidy(code), cc)
        fmt = self.format(country) if country else None
        if fmt is None:
            return None
        if national == "~":
            return codes.end_of(country) if bounds else None
        for s in codes.spellings(national, country):
            p = fmt.parse(s)
            if p is not None:
                return codes.assemble(country, fmt.tag, p)
        return None

    def parse_strict(self, code: str, cc: str | None = None) -> int:
        key = self.parse(code, cc, bounds=False)
        if key is not None:
            return key
        t = codes.tidy(code)
        own = re.match("([A-Za-z]{2})-", t)
        if cc is not None and not re.fullmatch("[A-Za-z]{2}", cc):
            raise CodeError(f'"{cc}" is not a two-letter country code')
        if cc is not None and own and codes.upper(own[1]) != codes.upper(cc):
            raise CodeError(f'country code "{cc}" does not match the "{t[:2]}-" prefix of "{t}"')
        if cc is None and not own:
            raise CodeError(f'"{t}" has no country: no "CC-" prefix, and no country code was given')
        country, national = codes.split_country(t, cc)
        if self.format_name(country) is None:
            raise CodeError(f'"{country}" is not a supported country code')
        raise CodeError(f'cannot parse "{national}" as a {self.describe(country)} postal code')

    def describe(self, cc: str) -> str:
        name = self.format_name(cc)
        return cc if name == "pattern" else name

    def text(self, key: int) -> str:
        if codes.tag_of(key) == END_TAG and not codes.payload_of(key):
            return codes.country_of(key) + "-~"
        fmt = self.format_of(key)
        t = fmt.text(codes.payload_of(key)) if fmt else None
        if t is None:
            raise CodeError("cannot render corrupted binary data to text")
        return f"{codes.country_of(key)}-{t}"

    def outcode(self, key: int) -> int | None:
        fmt = self.format_of(key)
        out = fmt.outcode(codes.payload_of(key)) if fmt else None
        return None if out is None else codes.assemble(codes.country_of(key), fmt.tag, out)

    def prefix(self, fragment: str) -> tuple[int, int] | None:
        """Keys [lo, hi) of the codes that begin with a fragment like "GB-LS2", or None."""
        country, national = codes.split_country(codes.tidy(fragment), None)
        fmt = self.format(country) if country else None
        if fmt is None:
            return None
        for s in codes.spellings(national, country):
            got = fmt.span(s)
            if got:
                return codes.assemble(country, fmt.tag, got[0]), codes.end_of(country) if got[1] is None else codes.assemble(country, fmt.tag, got[1])
        return None

    def prefix_strict(self, fragment: str) -> tuple[int, int]:
        got = self.prefix(fragment)
        if got is None:
            country, national = codes.split_country(codes.tidy(fragment), None)
            if country is None:
                raise CodeError('a postal code fragment requires a two-letter country prefix, e.g. "GB-LS24"')
            if self.format_name(country) is None:
                raise CodeError(f'"{country}" is not a supported country code')
            raise CodeError(f'cannot parse "{national}" as a fragment of a {self.describe(country)} postal code')
        return got

    # ---- named parts ------------------------------------------------------------------------------------

    def parts_pattern(self, cc: str, tag: int | None = None) -> str | None:
        """The pattern that names the parts of a country's codes, current or of a stored tag."""
        fmt = self.format(cc) if tag is None else codes.BY_TAG.get(tag)
        if tag is not None and fmt is None:
            lang = self.languages.get((cc, tag - FIRST_PATTERN_TAG + 1))
            return lang.pattern if lang and part_names(lang.pattern) else None
        if fmt is None:
            return None
        if isinstance(fmt, codes.Patterned):
            return fmt.regex if part_names(fmt.regex) else None
        return FORMAT_PARTS.get(fmt.name)

    def parts(self, key: int) -> dict[str, str | None] | None:
        """The named parts of a stored code, in their order; None if its format names none."""
        pattern = self.parts_pattern(codes.country_of(key), codes.tag_of(key))
        if pattern is None or codes.tag_of(key) == END_TAG:
            return None
        m = re.fullmatch(capture_regex(pattern), self.text(key)[3:])
        if m is None:
            raise CodeError(f'cannot split the postal code "{self.text(key)}" into parts')
        return dict(zip(part_names(pattern), m.groups()))

    def part(self, key: int, name: str) -> str | None:
        got = self.parts(key)
        cc = codes.country_of(key)
        if got is None:
            if codes.tag_of(key) == END_TAG:
                return None
            raise CodeError(f"postal codes of {cc} have no named parts")
        if name not in got:
            raise CodeError(f'postal codes of {cc} have no part called "{name}"')
        return got[name]

    def part_end(self, key: int, name: str) -> int | None:
        """How many characters of the code go up to the end of a part; None where it is absent."""
        if self.part(key, name) is None:
            return None
        m = re.fullmatch(capture_regex(self.parts_pattern(codes.country_of(key), codes.tag_of(key))), self.text(key)[3:])
        return m.end(part_names(self.parts_pattern(codes.country_of(key), codes.tag_of(key))).index(name) + 1)

    # ---- changes ----------------------------------------------------------------------------------------

    def _next(self, **changes) -> "Registry":
        return replace(self, snapshot=self.snapshot + 1, **changes)

    def add_country_format(self, cc: str, format_name: str) -> "Registry":
        iso2 = cc.upper()
        if not re.fullmatch("[A-Z]{2}", iso2):
            raise CodeError(f"country code must be exactly two letters, got {cc}")
        if format_name not in FORMATS:
            raise CodeError(f'format "{format_name}" does not exist; available: {", ".join(sorted(FORMATS))}')
        if format_name == "pattern" and not self.version(iso2):
            raise CodeError(f"country {iso2} has no pattern; give it one with add_country_template")
        return self._next(user=self.user | {iso2: (format_name, datetime.now(timezone.utc))})

    def remove_country_format(self, cc: str) -> "Registry":
        """Codes stored before go on being read."""
        iso2 = cc.upper()
        user = {k: v for k, v in self.user.items() if k != iso2}
        if iso2 in self.builtin:
            user[iso2] = (None, datetime.now(timezone.utc))
        return self._next(user=user)

    def add_country_template(self, cc: str, spec: str) -> "Registry":
        iso2 = cc.upper()
        if not re.fullmatch("[A-Z]{2}", iso2):
            raise CodeError(f"country code must be exactly two letters, got {cc}")
        regex = resolve(spec)
        parts_check(regex)
        v = self.version(iso2)
        now = self.languages.get((iso2, v))
        languages = dict(self.languages)
        if now is not None and same_codes(now.pattern, regex):
            if now.pattern != regex and now.source != spec:
                if now.builtin:
                    warnings.warn(f"the built-in language of {iso2} already denotes these codes and is kept as it is, with its own part names", stacklevel=2)
                else:
                    languages[iso2, v] = replace(now, source=spec, pattern=regex)
        elif v >= MAX_VERSION:
            raise CodeError(f"country {iso2} already has {MAX_VERSION} languages, the most there is room for")
        else:
            languages[iso2, v + 1] = Language(iso2, v + 1, spec, regex, False, datetime.now(timezone.utc))
        return replace(self, languages=languages).add_country_format(iso2, "pattern")

    def relabel(self, cc: str, spec: str, version: int | None = None) -> "Registry":
        """Name the parts of a language anew; the codes must stay the same."""
        v = version or self.version(cc)
        now, regex = self.languages[cc, v], resolve(spec)
        if not same_codes(now.pattern, regex):
            raise CodeError("languages are permanent: stored codes are decoded with them; add a new one with add_country_template")
        return self._next(languages=self.languages | {(cc, v): replace(now, source=spec, pattern=regex)})

    # ---- tables -----------------------------------------------------------------------------------------

    def formats_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(FORMATS.items()), "name string, description string")

    def languages_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(x.iso2, x.version, x.source, x.pattern, x.builtin, x.created_at) for _, x in sorted(self.languages.items())]
        return spark.createDataFrame(rows, "iso2 string, version short, source string, pattern string, builtin boolean, created_at timestamp")

    def country_formats(self, spark: SparkSession) -> DataFrame:
        """A user's assignment wins over a built-in one; a removed one is gone."""
        user = spark.createDataFrame([(c, f, t) for c, (f, t) in sorted(self.user.items())], "iso2 string, format_name string, assigned_at timestamp")
        own = spark.createDataFrame(sorted(self.builtin.items()), "iso2 string, format_name string")
        kept = own.join(user.select("iso2"), "iso2", "left_anti")
        return user.filter("format_name is not null").select("iso2", "format_name", F.lit(False).alias("builtin"), "assigned_at").unionByName(
            kept.select("iso2", "format_name", F.lit(True).alias("builtin"), F.lit(None).cast("timestamp").alias("assigned_at"))
        )

    def parts_frame(self, spark: SparkSession) -> DataFrame:
        """iso2, format, ord, name for all named parts."""
        compiled = [(f, list(language(p).names)) for f, p in FORMAT_PARTS.items()]
        fp = spark.createDataFrame(compiled, "format_name string, names array<string>")
        a = self.country_formats(spark).join(fp, "format_name").select("iso2", F.col("format_name").alias("format"), F.posexplode("names"))
        rows = [(x.iso2, f"pattern v{x.version}", part_names(x.pattern)) for _, x in sorted(self.languages.items())]
        b = spark.createDataFrame(rows, "iso2 string, format string, names array<string>").select("iso2", "format", F.posexplode("names"))
        return a.unionByName(b).select("iso2", "format", (F.col("pos") + 1).alias("ord"), F.col("col").alias("name"))

    def world(self, spark: SparkSession) -> DataFrame:
        """Every ISO country with its format; names come from the JVM's own list of countries."""
        locale = spark.sparkContext._jvm.java.util.Locale
        iso = sorted({*locale.getISOCountries(), "XK"})
        names = [(c, locale("en", c).getDisplayCountry(locale.ENGLISH)) for c in iso]
        told = {cc: basis for basis, countries in BASIS.items() for cc in countries}
        base = spark.createDataFrame([(c, n, told.get(c)) for c, n in names], "iso2 string, name string, basis string")
        latest = self.languages_frame(spark).withColumn("_r", F.row_number().over(Window.partitionBy("iso2").orderBy(F.desc("version")))).filter("_r = 1")
        out = base.join(self.country_formats(spark), "iso2", "left").join(latest.select("iso2", "source"), "iso2", "left")
        pattern = F.col("format_name") == "pattern"
        return out.select(
            "iso2",
            "name",
            F.when(pattern, F.col("source")).otherwise(F.col("format_name")).alias("format"),
            F.coalesce("builtin", F.lit(False)).alias("builtin"),
F.coalesce("basis", F.when(F.col("format_name").isNull(), "no postal codes").otherwise("GeoNames data")).alias("basis"),
        )

    # ---- user rows, saved and restored ------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """What users have added; the built-in part comes with the package."""
        rows = [(x.iso2, x.version, x.source, x.pattern, x.created_at) for x in self.languages.values() if not x.builtin]
        spark.createDataFrame(rows, "iso2 string, version int, source string, pattern string, created_at timestamp").write.mode("overwrite").parquet(f"{path}/languages")
        rows = [(c, f, t) for c, (f, t) in self.user.items()]
        spark.createDataFrame(rows, "iso2 string, format_name string, assigned_at timestamp").write.mode("overwrite").parquet(f"{path}/countries")

    def load(self, spark: SparkSession, path: str) -> "Registry":
        langs = {(r["iso2"], r["version"]): Language(r["iso2"], r["version"], r["source"], r["pattern"], False, r["created_at"]) for r in spark.read.parquet(f"{path}/languages").collect()}
        user = {r["iso2"]: (r["format_name"], r["assigned_at"]) for r in spark.read.parquet(f"{path}/countries").collect()}
        return self._next(languages=self.languages | langs, user=self.user | user)


@functools.cache
def world_registry() -> Registry:
    """The registry that comes with the package."""
    langs = {(cc, 1): Language(cc, 1, spec, resolve(NAMED_PATTERNS.get(cc, spec)), True) for cc, spec in PATTERNS.items()}
    return Registry(COMPILED_COUNTRIES | {cc: "pattern" for cc in PATTERNS}, langs)
