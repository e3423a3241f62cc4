"""Normalisers of single values: each gives (value or null, confidence) as columns."""

from __future__ import annotations

import json
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kinfold import vocabulary as V
from kinfold.functions.fuzzy import best_of
from kinfold.functions.text import filled, let, strip

# Fixed value: a valid address.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def email(c: Column) -> Column:
    """Lower-cased address, null if it isn't valid; confidence 1."""
    return let(F.lower(strip(c)), lambda clean: F.when(clean.rlike(EMAIL), clean))


def email_list(c: Column) -> Column:
    """Valid addresses, each once, in order; null if none is left."""
    good = F.array_sort(F.array_distinct(F.filter(F.transform(c, email), lambda x: x.isNotNull())))
    return let(good, lambda x: F.when(F.size(x) > 0, x))


def phone(c: Column, region: Column, plans: dict = V.PHONE_PLANS) -> Column:
    """E.164 of a number valid in its plan, else null; region (alpha-2) places numbers without a calling code.

    Plans cover the regions of kinfold.vocabulary. Of other regions, a number with a calling code of the public list is
    valid if its length is; without one it is null, never a guess.
    """
    digits = lambda text: F.regexp_replace(text, "[^0-9]", "")
    return let(strip(c), lambda text: let(digits(text), lambda found: let(region, lambda home: _phone(text, found, home, plans))))


def _phone(text: Column, digits: Column, region: Column, plans: dict) -> Column:
    sane = text.rlike(r"^[+(]?[\d\s().\-/]{6,}(?:\s*(?:ext|x)\.?\s*\d+)?\z") | text.rlike(r"^\+[\d\s().\-/]{6,}\z")
    ways = {code: (calling, f"(?:{trunk})?" if trunk else "", national) for code, (calling, trunk, national) in plans.items()}

    def abroad(body: Column) -> Column:
        found = F.lit(None).cast("string")
        for calling, optional, national in ways.values():
            full = rf"^{calling}{optional}({national})\z"
            found = F.coalesce(found, F.when(body.rlike(full), F.concat(F.lit("+" + calling), F.regexp_extract(body, full, 1))))
        planned = "|".join(sorted({calling for calling, _, _ in plans.values()}))
        other = rf"^(?!{planned})({V.CALLING_CODES})\d{{{V.LEAST_NATIONAL},}}\z"
        return F.coalesce(found, F.when(body.rlike(other) & (F.char_length(body) <= V.MOST_DIGITS), F.concat(F.lit("+"), body)))

    home = F.lit(None).cast("string")
    for code, (calling, optional, national) in ways.items():
        full, local = rf"^{calling}{optional}({national})\z", rf"^{optional}({national})\z"
        here = F.when(digits.rlike(local), F.concat(F.lit("+" + calling), F.regexp_extract(digits, local, 1)))
        here = F.coalesce(here, F.when(digits.rlike(full), F.concat(F.lit("+" + calling), F.regexp_extract(digits, full, 1))))
        home = F.when(region == code, here).otherwise(home)
    return F.when(sane, F.when(text.startswith("+") | digits.startswith("00"), let(F.regexp_replace(digits, "^00", ""), abroad)).otherwise(home))


def phone_list(c: Column, region: Column) -> Column:
    good = F.array_sort(F.array_distinct(F.filter(F.transform(F.array_distinct(c), lambda x: phone(x, region)), lambda x: x.isNotNull())))
    return let(good, lambda x: F.when(F.size(x) > 0, x))


@cache
def iso_countries() -> tuple[tuple[str, str, str], ...]:
    """(alpha-2, alpha-3, lower-case English name) of every ISO 3166 country, from the JVM's locale data."""
    locale = SparkSession.active()._jvm.java.util.Locale
    found = [locale("", code) for code in locale.getISOCountries()]
    return tuple((x.getCountry(), x.getISO3Country(), x.getDisplayCountry(locale.ENGLISH).lower()) for x in found)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """A dictionary of a few hundred constants as one map literal (a single string, folded once when planned).

    The map is searched from its start, so keys that it lacks are told by a hash set first.
    """
    if not pairs:
        return F.lit(None).cast("string")
    packed = "\x02".join(f"{k}\x03{v}" for k, v in pairs.items())
    return let(key, lambda k: F.when(k.isin(list(pairs)), F.try_element_at(F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x03")), k)))


_MARKS = {"àáâãäå": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ñ": "n", "òóôõöø": "o", "ùúûü": "u", "ýÿ": "y"}
_UNMARKED = {x: y for group, y in _MARKS.items() for x in group}


def _plain(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), "".join(_UNMARKED), "".join(_UNMARKED.values()))


def _country_like(text: Column) -> Column:
    """Code of the country whose name holds the text earliest, of equal ones the first code; null if none does.

    Names are made plain here, not once a row; a text that stands nowhere in all of them isn't looked for in each.
    """
    plain = [(code, name.translate(str.maketrans(_UNMARKED))) for code, _, name in iso_countries()]
    names = F.split(F.lit("\x02".join(f"{code}{name}" for code, name in plain)), "\x02")
    places = F.transform(names, lambda n: F.struct((F.instr(n, text) - 3).alias("at"), F.substring(n, 1, 2).alias("code")))
    # from the 13th place on all count alike
    ranked = F.transform(F.filter(places, lambda x: x["at"] >= 0), lambda x: F.struct(F.least(x["at"], F.lit(13)).alias("at"), x["code"].alias("code")))
    return F.when(F.lit("\x02".join(name for _, name in plain)).contains(text), F.array_min(ranked)["code"])


def country(c: Column) -> Column:
    """struct(code, confidence): alpha-2 and alpha-3 codes 1.0, informal and official names .95, parts of a name (four
    letters or more) .85, else null. Names of a country's parts (states, provinces) aren't known."""
    iso = iso_countries()
    names = {n: a for a, _, n in iso} | {a.lower(): a for a, _, _ in iso} | {b.lower(): a for a, b, _ in iso}
    said = lambda code, confidence: F.struct(code.alias("code"), F.lit(confidence).alias("confidence"))
    # each way only where the ones before it found nothing
    or_else = lambda code, confidence, rest: let(code, lambda x: F.when(x.isNotNull(), said(x, confidence)).otherwise(rest))

    def told(clean: Column) -> Column:
        upper, lower = F.upper(clean), F.lower(clean)
        by_code = F.when(F.char_length(clean) == 2, F.when(upper.isin([a for a, _, _ in iso]), upper)).when(F.char_length(clean) == 3, _lookup({b: a for a, b, _ in iso}, upper))
        by_name = F.coalesce(_lookup(V.COUNTRY_ALIASES, lower), _lookup(names, lower))
        like = F.when(F.char_length(clean) > 3, let(_plain(clean), _country_like))
        return or_else(by_code, 1.0, or_else(by_name, 0.95, let(like, lambda x: F.when(x.isNotNull(), said(x, 0.85)))))

    return let(strip(c), told)


@F.pandas_udf(StructType([StructField("date", StringType()), StructField("confidence", DoubleType())]))
def _loose_date(raw: pd.Series) -> pd.DataFrame:
    """Dates that no fixed form fits, read leniently; a month that isn't in the text doesn't count."""
    import re
    from datetime import datetime

    from dateutil import parser

    names = [*_MONTHS, *(m[:3] for m in _MONTHS)]

    def read(text: str | None) -> tuple[str | None, float | None]:
        if text is None:
            return None, None
        try:
            found = parser.parse(text, default=datetime(1, 1, 1), fuzzy=True)
        except (ValueError, OverflowError):
            return None, None
        month = found.month != 1 or any(n in text.lower() for n in names)
        year = re.search(r"\b(\d{4})\b", text)
        if found.year == 1 and not year:
            return None, None
        if month:
            return f"{found.year:04d}-{found.month:02d}", 0.9
        return (str(found.year) if found.year != 1 else year[1]), 0.8

    return pd.DataFrame([read(x) for x in raw], columns=["date", "confidence"])


def date(c: Column, lenient: bool = True) -> Column:
    """struct(date, confidence): YYYY-MM at 1.0, YYYY at 0.8, read leniently at 0.9 or 0.8; ongoing and unreadable: null."""
    text = F.lower(filled(c))
    month = "|".join([m for m in _MONTHS] + [m[:3] for m in _MONTHS])
    of_name = lambda pattern, g: _lookup({k: f"{i % 12 + 1:02d}" for i, k in enumerate([*_MONTHS, *(m[:3] for m in _MONTHS)])}, F.regexp_extract(text, pattern, g))
    forms = [(rf"^({month}),?\s+(\d{{4}})\z", "name", 2, 1), (rf"^(\d{{4}})\s+({month})\z", "name", 1, 2), (r"^(1[0-2]|0?[1-9])[/.\-](\d{4})\z", "digits", 2, 1), (r"^(\d{4})[/.\-](1[0-2]|0?[1-9])\z", "digits", 1, 2)]
    full = reduce(F.coalesce, [F.when(text.rlike(p), F.concat(F.regexp_extract(text, p, y), F.lit("-"), of_name(p, m) if kind == "name" else F.lpad(F.regexp_extract(text, p, m), 2, "0"))) for p, kind, y, m in forms])
    year_only = text.rlike(r"^\d{4}\z")
    year = F.when(year_only & text.between("1900", "2100"), text)
    told = F.when(full.isNotNull(), F.struct(full.alias("date"), F.lit(1.0).alias("confidence"))).when(year.isNotNull(), F.struct(year.alias("date"), F.lit(0.8).alias("confidence")))
    if lenient:
        rest = F.when(full.isNull() & ~year_only & ~text.isin(*V.ONGOING), filled(c))
        loose = _loose_date(rest)
        told = F.coalesce(told, F.when(loose["date"].isNotNull(), loose))
    return F.when(~text.isin(*V.ONGOING), told)


class SkillDictionary:
    """Canonical skill names by alias; a dictionary or a JSON file replaces the built-in one."""

    def __init__(self, aliases: dict[str, str] | None = None, path: str | None = None, threshold: float = V.SKILL_THRESHOLD):
        found = aliases
        if found is None and path is not None:
            try:
                with open(path, encoding="utf-8") as file:
                    found = json.load(file)
            except (OSError, ValueError):
                found = None
        self.aliases = {k.lower().strip(): v for k, v in found.items()} if found is not None else dict(V.SKILL_ALIASES)
        self.names, self.threshold = tuple(sorted(set(self.aliases.values()))), threshold

    def exact(self, c: Column) -> Column:
        """The canonical name of an alias; hyphens and underscores of the text count as spaces."""
        key = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[-_]+", " "), r"(?U)\s+", " ")
        return _lookup(self.aliases, key)

    def fuzzy(self):
        """Arrow UDF: array of names to array of (name, confidence), null where no canonical name is near."""
        names, threshold = self.names, self.threshold

        @F.pandas_udf("array<struct<name:string,confidence:double>>")
        def match(skills: pd.Series) -> pd.Series:
            near = lru_cache(200_000)(lambda s: best_of(s, names, threshold))

            def one(s: str) -> dict | None:
                found = near(s)
                return {"name": found[0], "confidence": found[1] / 100.0} if found else None

            return pd.Series([None if row is None else [one(s) for s in row] for row in skills])

        return match

    def normalize(self, c: Column) -> Column:
        """array<struct<name, confidence, raw>>: each canonical name once with its best confidence, by name; null if none.

        Aliases count 1.0, near names their score, others stay as they are at 0.5; of equal ones the first counts. Only
        names without an alias leave the JVM, and a worker scores each of them once.
        """
        clean = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))
        looked = F.transform(clean, lambda x, i: F.struct(x.alias("raw"), i.alias("i"), self.exact(x).alias("name")))
        unknown = lambda entries: F.filter(entries, lambda e: e["name"].isNull())
        scored = self.fuzzy()(F.transform(unknown(looked), lambda e: e["raw"]))
        entry = lambda name, less, i, raw: F.struct(name.alias("name"), less.alias("less"), i.alias("i"), raw.alias("raw"))
        same = lambda done, e: F.coalesce(F.try_element_at(done, F.lit(-1))["name"] == e["name"], F.lit(False))
        none = F.array().cast("array<struct<name:string,less:double,i:int,raw:string>>")

        def first(p: Column) -> Column:
            known = F.transform(F.filter(p["looked"], lambda e: e["name"].isNotNull()), lambda e: entry(e["name"], F.lit(-1.0), e["i"], e["raw"]))
            rest = F.zip_with(unknown(p["looked"]), p["scored"], lambda e, s: entry(F.coalesce(s["name"], e["raw"]), -F.coalesce(s["confidence"], F.lit(V.UNKNOWN_SKILL)), e["i"], e["raw"]))
            return F.aggregate(F.array_sort(F.concat(known, rest)), none, lambda done, e: F.when(same(done, e), done).otherwise(F.array_append(done, e)))

        out = lambda found: F.when(F.size(found) > 0, F.transform(found, lambda e: F.struct(e["name"].alias("name"), (-e["less"]).alias("confidence"), e["raw"].alias("raw"))))
        return let(let(F.struct(looked.alias("looked"), scored.alias("scored")), first), out)
