"""Readings of a typed timestamp as an array of interpretations, in Catalyst expressions only.

``readings`` gives ``array<struct<fmt string, us bigint, rule boolean>>``: every instant a text can stand for,
``rule`` telling whether the reading follows the declared conventions (day before month unless the year comes first,
the earlier of two equal local times). Unreadable, impossible and NULL texts give an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vahini.functions.text import ascii_digits, squeeze

# Zone abbreviations and their offsets. IST is Indian time.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "ist": "+05:30", "est": "-05:00", "edt": "-04:00", "cst": "-06:00",
    "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "cet": "+01:00",
    "cest": "+02:00", "bst": "+01:00", "eet": "+02:00", "eest": "+03:00", "jst": "+09:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(z|[a-z]{3,4}|[+-]\d{2}:?\d{2})?"
_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(\.\d{1,9})?)?\s*(am|pm|a\.m\.|p\.m\.)?\s*" + _ZONE
_TAIL = rf"(?:(?:t|\s|,|at)+{_CLOCK})?$"
# Groups 1-3 are the date; 4-9 hour, minute, second, fraction, half of the day, zone.
YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}"
DAY_FIRST = (
    r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(\d{1,2})(?:st|nd|rd|th)?\s?[-/. ]\s?(\d{1,2}|[a-z]{3,9})\.?,?\s?"
    rf"[-/. ]?\s?(\d{{4}}|\d{{2}})(?!\d){_TAIL}"
)
COMPACT = r"^(\d{4})(\d{2})(\d{2})t(\d{2}):?(\d{2}):?(\d{2})?(\.\d{1,9})?()" + _ZONE + "$"
NUMBER = r"^\d{1,15}$"
HOUR = 3_600_000_000


def _zone(z: Column, default: Column) -> Column:
    """An offset or region; NULL for an abbreviation that is not listed."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), z)
    offset = F.regexp_replace(z, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.when(F.coalesce(z, F.lit("")) == "", default).when(z.rlike(r"^[+-]"), offset).otherwise(named)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; a plain expression would be computed at every mention."""
    return F.transform(F.array(value), use)[0]


def _instant(y: Column, mo: Column, d: Column, g: Column, default: Column) -> Column:
    """Microseconds of the parts, NULL where no such date, time or zone exists. ``g``: the groups, clock from 4 on."""
    part = lambda i: F.nullif(g[i], F.lit(""))
    typed, half = F.coalesce(part(3).cast("int"), F.lit(0)), F.substring(g[7], 1, 1)
    hour = F.when(half == "", typed).when(typed.between(1, 12), typed % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.concat(F.coalesce(part(5), F.lit("0")), F.substring(F.coalesce(part(6), F.lit(".0")), 1, 7))
    minute = F.coalesce(part(4).cast("int"), F.lit(0))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int")
    at = F.call_function(
        "try_make_timestamp", year, mo.cast("int"), d.cast("int"), hour, minute, seconds.cast("decimal(16,6)"), _zone(g[8], default)
    )
    return F.when((minute < 60) & (F.coalesce(part(5), F.lit("0")).cast("int") < 60) & (year > 0), F.unix_micros(at))


def _month(c: Column) -> Column:
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(c, 1, 3)).cast("int")
    return F.when(c.rlike(r"^\d"), F.lit(None).cast("int")).otherwise(F.nullif(named, F.lit(0)))


def _local(us: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(us), zone)


_NONE = "array<struct<fmt:string,us:bigint,rule:boolean>>"


def readings(c: Column, default_zone: Column | str = "+05:30") -> Column:
    """All interpretations of a text. ``default_zone``: for texts without one; NULL counts as Indian time."""
    zone = F.coalesce(F.lit(default_zone) if isinstance(default_zone, str) else default_zone, F.lit("+05:30"))

    def read(fmt: str, us: Column, rule: bool = True) -> Column:
        return F.when(us.isNotNull(), F.struct(F.lit(fmt).alias("fmt"), us.alias("us"), F.lit(rule).alias("rule")))

    def groups(s: Column, pattern: str) -> Column:
        return F.split(F.regexp_replace(s, pattern, "|".join(f"${i}" for i in range(1, 10))), r"\|")

    def year_first(g: Column) -> Column:
        def both(us: Column) -> Column:
            # The same wall time can come again an hour later, when clocks go back.
            again = F.when((g[8] == "") & (_local(us, zone) == _local(us + HOUR, zone)), us + HOUR)
            return F.array(read("ymd", us), read("ymd-again", again, False))

        return _let(_instant(g[0], g[1], g[2], g, zone), both)

    def day_first(g: Column) -> Column:
        number = F.when(g[1].rlike(r"^\d"), g[1].cast("int"))
        return F.when(
            number.isNotNull(),
            F.array(
                _let(_instant(g[2], number, g[0], g, zone), lambda us: read("dmy", us)),
                _let(F.when((g[0].cast("int") < 13) & (g[0].cast("int") != number), _instant(g[2], g[0], number, g, zone)), lambda us: read("mdy", us, False)),
            ),
        ).otherwise(F.array(_let(_instant(g[2], _month(g[1]), g[0], g, zone), lambda us: read("d-mon-y", us))))

    def of(s: Column) -> Column:
        epoch = F.when(F.length(s) < 12, read("s", s.cast("long") * 1_000_000)).otherwise(read("ms", s.cast("long") * 1000))
        return (
            F.when(s.rlike(NUMBER), F.array(epoch))
            .when(s.rlike(YEAR_FIRST), _let(groups(s, YEAR_FIRST), year_first))
            .when(s.rlike(DAY_FIRST), _let(groups(s, DAY_FIRST), day_first))
            .when(s.rlike(COMPACT), _let(groups(s, COMPACT), lambda g: F.array(_let(_instant(g[0], g[1], g[2], g, zone), lambda us: read("compact", us)))))
        )

    found = _let(F.lower(ascii_digits(squeeze(c))), of)
    return F.coalesce(F.array_compact(found), F.expr("array()").cast(_NONE))


def instant_us(c: Column, default_zone: Column | str = "+05:30") -> Column:
    """The one reading that follows the conventions, in microseconds; NULL where there is none."""
    return F.try_element_at(F.filter(readings(c, default_zone), lambda r: r["rule"]), F.lit(1))["us"]


PORTAL_FORMATS = ("d-MMM-yyyy h:mm a", "d-MMM-yyyy H:mm", "d-MMM-yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy-M-d")


def portal_time(c: Column) -> Column:
    """The first of the portal formats that reads the text, as local time without a zone; NULL if none does."""
    return F.coalesce(*[F.call_function("try_to_timestamp", F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in PORTAL_FORMATS])


def code_date(c: Column) -> Column:
    """The date in the first eight digits of a document code, NULL where they are none."""
    return F.call_function("try_to_timestamp", F.substring(c, 1, 8), F.lit("yyyyMMdd")).cast("date")


def days_close(a: Column, b: Column, days: int = 1) -> Column:
    """At most so many days apart; two unknown days are close, one isn't."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(F.datediff(a, b)) <= days)


def epoch_or_zero(c: Column) -> Column:
    """Seconds since 1970 of a portal time (taken as UTC), 0 where it can't be read."""
    return F.coalesce(F.unix_timestamp(portal_time(c).cast("timestamp")), F.lit(0))


def iso_day(c: Column) -> Column:
    """dd-mm-yyyy and dd/mm/yyyy as yyyy-mm-dd, NULL for other texts and impossible days."""
    day = F.call_function("try_to_timestamp", F.regexp_replace(F.trim(c), "/", "-"), F.lit("d-M-yyyy"))
    return F.when(F.trim(c).rlike(r"^\d{1,2}([-/])\d{1,2}\1\d{4}$"), F.date_format(day, "yyyy-MM-dd"))


def indian_label(ts: Column) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts.cast("timestamp_ntz")), "dd MMM yyyy, HH:mm 'IST'")


def indian_iso(ts: Column) -> Column:
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
