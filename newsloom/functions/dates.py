"""Date formats of feeds and of the article-list API. Unreadable dates become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone names RFC 2822 defines, as minutes east of UTC.
RFC_ZONES = {
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "AST": -240,
    "ADT": -180,
    "EST": -300,
    "EDT": -240,
    "CST": -360,
    "CDT": -300,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
}

# day, month name, year, hour, minute, second, zone
_RFC = (
    r"^\s*(?:[A-Za-z]+\s*,?\s+)?(\d{1,2})[ -]+([A-Za-z]{3})[a-z]*[ -]+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]+|[+-]\d{4})?\b"
)
_ISO = r"^\s*\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2})"
_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
_ISO_LOCAL = r"^\d{4}-\d{2}-\d{2}[T ][0-9:.]+$"
_ISO_BASIC = r"^\s*\d{8}T\d{6}\s*$"


def _zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC. Unknown names and no zone count as UTC."""
    names = F.create_map(*[F.lit(x) for pair in RFC_ZONES.items() for x in pair])
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 4, 2).try_cast("int")
    numeric = sign * (hours * 60 + minutes)
    return F.coalesce(
        F.when(zone.rlike(r"^[+-]"), numeric), F.element_at(names, F.upper(zone)), F.lit(0)
    )


def _rfc_timestamp(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, _RFC, i)

    year = part(3)
    full_year = (
        F.when(F.length(year) == 4, year)
        .when(year.try_cast("int") < 69, F.concat(F.lit("20"), year))
        .otherwise(F.concat(F.lit("19"), year))
    )
    plain = F.concat_ws(
        " ",
        part(1),
        F.initcap(part(2)),
        full_year,
        F.concat_ws(":", part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))),
    )
    local = _utc(plain, "d MMM yyyy H:mm:ss")
    return F.when(text.rlike(_RFC), local - F.make_dt_interval(mins=_zone_minutes(part(7))))


def _utc(text: Column, pattern: str) -> Column:
    """A text without zone as an instant in UTC, whatever the session's zone is."""
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} xx"))


def _iso_timestamp(text: Column) -> Column:
    plain = F.trim(text)
    zoned = (
        F.when(plain.rlike(_ISO_DAY), F.concat(plain, F.lit("T00:00:00Z")))
        .when(plain.rlike(_ISO_LOCAL), F.concat(plain, F.lit("Z")))
        .otherwise(plain)
    )
    return F.coalesce(
        F.when(text.rlike(_ISO), zoned.try_cast("timestamp")),
        F.when(text.rlike(_ISO_BASIC), _utc(plain, "yyyyMMdd'T'HHmmss")),
    )


def parse_feed_date(c: Column) -> Column:
    """RFC 2822, else ISO 8601; a date without zone counts as UTC."""
    return F.coalesce(_rfc_timestamp(c), _iso_timestamp(c))


def parse_compact_date(c: Column) -> Column:
    """``yyyyMMddTHHmmss`` with or without trailing ``Z``, in UTC."""
    text = F.regexp_replace(c, "Z+$", "")
    return F.when(text.rlike(r"^\d{8}T\d{6}$"), _utc(text, "yyyyMMdd'T'HHmmss"))


def utc_day(instant: Column) -> Column:
    """The UTC day of an instant, whatever the session's zone is."""
    return F.to_date(F.to_utc_timestamp(instant, F.current_timezone()))


def hours_before(as_of: Column, hours: float) -> Column:
    return as_of - F.expr(f"make_dt_interval(0, 0, 0, {float(hours) * 3600:.3f})")


def since(as_of: Column, hours: float, day_granular: bool = False) -> Column:
    """Start of a "last N hours" window; ``day_granular`` rounds it down to the UTC day."""
    start = hours_before(as_of, hours)
    return F.timestamp_seconds(F.unix_date(utc_day(start)) * 86400) if day_granular else start
