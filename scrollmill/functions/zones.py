"""The display clock: which zone a name means, local times, days and labels.

Columns are UTC timestamps without zone, as the store keeps them.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of an empty or unknown name, and how it is labelled.
DEFAULT = ("Asia/Seoul", "KST")


def resolve(name: str | None) -> tuple[str, str | None]:
    """(zone id, fixed label or None if it follows the season) of a configured name:
    KST, local, UTC, an offset like +5:30, or a region."""
    v = (name or "").strip()
    if not v or v.upper() == "KST":
        return DEFAULT
    if v.lower() == "local":
        return "SYSTEM", None
    if v.upper() in ("UTC", "GMT", "Z"):
        return "UTC", "UTC"
    if (m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?", v, re.IGNORECASE)) and int(m[2]) <= 14 and int(m[3] or 0) < 60:
        offset = f"{m[1]}{int(m[2]):02d}:{m[3] or '00'}"
        return offset, f"UTC{offset}"
    try:
        zoneinfo.ZoneInfo(v)
    except (ValueError, OSError, KeyError):
        return DEFAULT
    return v, None


def _zone(name: str | None) -> Column:
    zone = resolve(name)[0]
    return F.current_timezone() if zone == "SYSTEM" else F.lit(zone)


def local_time(ts: Column, zone: str | None = None) -> Column:
    return F.convert_timezone(F.lit("UTC"), _zone(zone), ts)


def local_text(ts: Column, zone: str | None = None, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(local_time(ts, zone), pattern)


def local_date(ts: Column, zone: str | None = None) -> Column:
    return F.to_date(local_time(ts, zone))


def label(ts: Column, zone: str | None = None) -> Column:
    """The zone's short name at an instant: fixed ones as they are, regions by
    whether their clock is ahead then."""
    zone_id, fixed = resolve(zone)
    if fixed:
        return F.lit(fixed)
    ahead = (F.unix_micros(local_time(ts, zone).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60_000_000
    names = {}
    if zone_id != "SYSTEM":
        import datetime

        for month in range(1, 13):
            d = datetime.datetime(2024, month, 1, 12, tzinfo=zoneinfo.ZoneInfo(zone_id))
            names[int(d.utcoffset().total_seconds() // 60)] = d.tzname()
    shown = F.format_string("UTC%+03d:%02d", (ahead / 60).cast("int"), F.abs(ahead).cast("int") % 60)
    for minutes, name in names.items():
        shown = F.when(ahead == minutes, name).otherwise(shown)
    return shown


def local_text_labelled(ts: Column, zone: str | None = None) -> Column:
    return F.concat_ws(" ", local_text(ts, zone), label(ts, zone))


def label_of_day(day: Column, zone: str | None = None) -> Column:
    """The name at the day's noon."""
    noon = day.cast("date").cast("timestamp_ntz") + F.expr("interval 12 hours")
    return label(F.convert_timezone(_zone(zone), F.lit("UTC"), noon), zone)


def day_bounds(day: Column, zone: str | None = None) -> Column:
    """struct<lo, hi>: the UTC range of a day on that clock, 23 to 25 hours long."""
    at = lambda d: F.convert_timezone(_zone(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    d = day.cast("date")
    return F.struct(at(d).alias("lo"), at(F.date_add(d, 1)).alias("hi"))


def in_day(ts: Column, day: str, zone: str | None = None) -> Column:
    bounds = day_bounds(F.lit(day), zone)
    return (ts >= bounds["lo"]) & (ts < bounds["hi"])
