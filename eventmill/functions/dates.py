"""Date columns: French dates and times in text, calendar terms, and wall-clock arithmetic.

The only clock is the ``as_of`` column that a function takes. Dates are TIMESTAMP_NTZ, that is
wall-clock time at the place of the event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# French names of months and days.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
PLAIN_MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
SHORT_DAYS = ("Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim")
DEFAULT_HOUR = 20

_W = r"[\p{L}\p{M}\p{N}_]+"
_NAMES = "|".join(dict.fromkeys((*MONTHS, *PLAIN_MONTHS)))


def _choice(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def _number(c: Column) -> Column:
    """An integer, null for an empty text."""
    return F.nullif(c, F.lit("")).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once for a row however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def month_number(name: Column) -> Column:
    """1 to 12, null for what is no month's name, accents or not."""
    place = lambda values: F.array_position(F.array(*map(F.lit, values)), F.lower(name))
    return F.nullif(F.greatest(place(MONTHS), place(PLAIN_MONTHS)), F.lit(0)).cast("int")


def make_ts(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None) -> Column:
    """A timestamp, null where the parts make none."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero if hour is None else hour, zero if minute is None else minute, F.lit(0).cast("decimal(16,6)"))


def year_of(as_of: Column) -> Column:
    return F.year(as_of)


def infer_year(month: Column, day: Column, as_of: Column, reference: Column | None = None) -> Column:
    """The reference year, or the next if the date lies more than 30 whole days back."""
    year = year_of(as_of) if reference is None else reference
    passed = F.timestamp_diff("SECOND", make_ts(year, month, day), as_of)
    return F.when(F.floor(passed / 86400) > 30, year + 1).otherwise(year)


def parse_time_generic(c: Column) -> Column:
    """HH:MM of the first 19h30, 19:30, 19h or 19 h; hours aren't checked."""
    full, short = r"([0-9]{1,2})[hH:]([0-9]{2})", r"([0-9]{1,2})\s*[hH]"
    return (
        F.when(c.rlike(full), F.concat(F.lpad(F.regexp_extract(c, full, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, full, 2)))
        .when(c.rlike(short), F.concat(F.lpad(F.regexp_extract(c, short, 1), 2, "0"), F.lit(":00")))
    )


def parse_french_time(c: Column) -> Column:
    """Minutes after midnight of the first 19h30 or 19h, else of the first 19:30, if in range."""
    h, m = _number(F.regexp_extract(c, r"([0-9]{1,2})[hH]([0-9]{2})?", 1)), F.coalesce(_number(F.regexp_extract(c, r"([0-9]{1,2})[hH]([0-9]{2})?", 2)), F.lit(0))
    colon = r"(?<![\p{L}\p{N}_])([0-9]{1,2}):([0-9]{2})(?![\p{L}\p{N}_])"
    h2, m2 = _number(F.regexp_extract(c, colon, 1)), _number(F.regexp_extract(c, colon, 2))
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m).when(h2.between(0, 23) & m2.between(0, 59), h2 * 60 + m2)


def parse_date_generic(c: Column, as_of: Column) -> Column:
    """``26 janvier [2026]``, ``26/01[/[20]26]``, ``26-01-2026`` or ``2026-01-26``; a missing year is the current one."""
    text = F.lower(F.trim(c))
    word = rf"([0-9]{{1,2}})\s+({_W})(?:\s+([0-9]{{4}}))?"
    slash = r"([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{2,4}))?"
    year = F.coalesce(_number(F.regexp_extract(text, word, 3)), year_of(as_of))
    named = make_ts(year, month_number(F.regexp_extract(text, word, 2)), _number(F.regexp_extract(text, word, 1)))
    y = _number(F.regexp_extract(text, slash, 3))
    y = F.coalesce(F.when(y < 100, y + 2000).otherwise(y), year_of(as_of))
    slashed = make_ts(y, _number(F.regexp_extract(text, slash, 2)), _number(F.regexp_extract(text, slash, 1)))
    part = lambda p, g: _number(F.regexp_extract(text, p, g))
    dmy, ymd = r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    return F.coalesce(named, slashed, make_ts(part(dmy, 3), part(dmy, 2), part(dmy, 1)), make_ts(part(ymd, 1), part(ymd, 2), part(ymd, 3)))


def parse_french_date(c: Column, as_of: Column, default_minutes: int = DEFAULT_HOUR * 60) -> Column:
    """Start of a range with a year, else a date with a year, else a date whose year is inferred.

    Of each pattern only the first hit counts. The time is the first in the text, else the default.
    """
    ranged = rf"du\s+([0-9]{{1,2}})\s+({_W})(?:\s+au\s+[0-9]{{1,2}}\s+{_W})?\s+([0-9]{{4}})"
    dated = rf"([0-9]{{1,2}})\s+({_W})\s+([0-9]{{4}})"
    bare = rf"([0-9]{{1,2}})\s+({_W})"

    def read(s: Column) -> Column:
        def at(pattern: str, reference: Column | None) -> Column:
            part = lambda i: F.regexp_extract(s["text"], pattern, i)
            found = F.struct(_number(part(1)).alias("day"), month_number(part(2)).alias("month"), (_number(part(3)) if reference is None else reference).alias("year"))

            def make(d: Column) -> Column:
                year = d["year"] if reference is None else infer_year(d["month"], d["day"], as_of, d["year"])
                return make_ts(year, d["month"], d["day"], F.floor(s["minutes"] / 60).cast("int"), (s["minutes"] % 60).cast("int"))

            return _let(found, make)

        return F.coalesce(at(ranged, None), at(dated, None), at(bare, year_of(as_of)))

    text = F.lower(F.trim(c))
    return _let(text, lambda t: _let(F.struct(t.alias("text"), F.coalesce(parse_french_time(t), F.lit(default_minutes)).alias("minutes")), read))


def expand_french_dates(c: Column, as_of: Column) -> Column:
    """All dates of a range in one month, of a list, of an end (``Jusqu'au``), or of a single date; at the default hour."""
    hour = F.lit(DEFAULT_HOUR)
    ranged = rf"du\s+([0-9]{{1,2}})\s+(?:{_W}\s+)?au\s+([0-9]{{1,2}})\s+({_W})(?:\s+([0-9]{{4}}))?"
    listed = rf"((?:[0-9]{{1,2}}\s*,\s*)*[0-9]{{1,2}})\s+et\s+([0-9]{{1,2}})\s+({_W})(?:\s+([0-9]{{4}}))?"
    until = rf"jusqu['’‘]?\s*au\s+([0-9]{{1,2}})\s+({_W})(?:\s+([0-9]{{4}}))?"

    def read(text: Column) -> Column:
        group = lambda p, i: F.regexp_extract(text, p, i)

        def dates(days: Column, pattern: str, month: int) -> Column:
            when = F.struct(month_number(group(pattern, month)).alias("m"), F.coalesce(_number(group(pattern, month + 1)), year_of(as_of)).alias("y"))
            made = _let(when, lambda w: F.filter(F.transform(days, lambda d: make_ts(w["y"], w["m"], d, hour)), lambda t: t.isNotNull()))
            return _let(made, lambda a: F.when(F.size(a) > 0, a))

        first, last = _number(group(ranged, 1)), _number(group(ranged, 2))
        span = F.when(first <= last, F.sequence(first, last))
        several = F.array_append(F.transform(F.regexp_extract_all(group(listed, 1), F.lit("([0-9]{1,2})"), 1), _number), _number(group(listed, 2)))
        return F.coalesce(dates(span, ranged, 3), dates(several, listed, 3), dates(F.array(_number(group(until, 1))), until, 2))

    single = _let(parse_french_date(c, as_of), lambda t: F.when(t.isNotNull(), F.array(t)))
    found = _let(F.regexp_replace(F.lower(F.trim(c)), r"^[àa]\s+venir\s*", ""), read)
    return F.coalesce(found, single, F.array().cast("array<timestamp_ntz>"))


def parse_iso_local(c: Column, zone: str = "Europe/Paris") -> Column:
    """ISO 8601 as wall-clock time in ``zone``: an offset or Z is converted, a naive text already is local."""
    zoned = c.rlike(r"T.*(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), c.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, local).otherwise(c.try_cast("timestamp_ntz"))


def default_midnight_to_20h(ts: Column) -> Column:
    return F.when((F.hour(ts) == 0) & (F.minute(ts) == 0), ts + F.make_dt_interval(F.lit(0), F.lit(20))).otherwise(ts)


def french_date_term(ts: Column) -> Column:
    """``lundi-05-janvier``, unaccented."""
    return F.concat_ws("-", _choice(DAYS, F.weekday(ts)), F.date_format(ts, "dd"), _choice(PLAIN_MONTHS, F.month(ts) - 1))


def format_french_date_long(ts: Column) -> Column:
    """``27 janvier 2026``."""
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), _choice(MONTHS, F.month(ts) - 1), F.year(ts).cast("string"))


def expiry_ts(ts: Column) -> Column:
    """Midnight of the following day."""
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))


def start_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def day_label(day: Column, today: Column) -> Column:
    return F.when(day == today, "Aujourd'hui").otherwise(_choice(SHORT_DAYS, F.weekday(day)))


def looks_like_date(c: Column) -> Column:
    text = F.lower(c)
    return text.rlike(_NAMES) | text.rlike(r"^du\s+[0-9]") | text.startswith("jusqu")
