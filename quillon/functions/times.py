"""Time expressions: parsing of many formats, periods, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy年M月d日"]


def parse_time(text: Column) -> Column:
    """A timestamp from any of FORMATS, or from epoch seconds of ten digits or more; else null."""
    epoch = F.when(text.rlike("^[0-9]{10,}$"), F.timestamp_seconds(F.substring(text, 1, 10).try_cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])


def parse_date(text: Column) -> Column:
    return parse_time(text).cast("date")


def period(day: Column, grain: str) -> Column:
    """2025, 2025-Q2, 2025-06, 2025-W24 or 2025-06-15."""
    if grain == "year":
        return F.date_format(day, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    if grain == "week":
        return F.concat(F.extract(F.lit("yearofweek"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    return F.date_format(day, "yyyy-MM" if grain == "month" else "yyyy-MM-dd")


def norm_period(text: Column) -> Column:
    """202601 and 2026/1 as 2026-01; null for anything else."""
    year, month = F.regexp_extract(text, "^([0-9]{4})[-/.]?([0-9]{1,2})$", 1), F.regexp_extract(text, "^([0-9]{4})[-/.]?([0-9]{1,2})$", 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def parse_hour(text: Column, default: int = 12) -> Column:
    """The hour of HH, HH:MM[:SS] or an ISO time; ``default`` where there is none."""
    plain = F.when(text.rlike("^[0-9]{1,2}$"), text.try_cast("int"))
    clock = F.regexp_extract(text, "(?:^|[T ])([0-9]{1,2}):[0-9]{2}", 1)
    return F.coalesce(plain, F.when(clock != "", clock.try_cast("int")), F.lit(default))


def days_between(a: Column, b: Column) -> Column:
    """Fractional days from a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400e6


_MOMENT = "^([0-9]{4})[-/.年]?([0-9]{1,2})[-/.月]?(?:([0-9]{1,2})日?)?(?:[T ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[.][0-9]+)?)? ?(Z|[+-][0-9]{2}:?[0-9]{2})?$"


def parse_moment(text: Column, zone: str = "Asia/Shanghai") -> Column:
    """A time in UTC, without a zone, from a date, a month or a time in any of the usual ways of writing them, or from epoch
    seconds or milliseconds; what names no zone is read in ``zone``. Null for anything else."""
    bare = F.trim(text.cast("string"))
    part = lambda k: F.regexp_extract(bare, _MOMENT, k)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.when(part(3) == "", "01").otherwise(F.lpad(part(3), 2, "0")))
    clock = F.concat_ws(":", F.lpad(part(4), 2, "0"), F.lpad(part(5), 2, "0"), F.lpad(part(6), 2, "0"))
    local = F.when(part(1) != "", F.concat_ws(" ", day, clock)).try_cast("timestamp_ntz")
    offset = F.regexp_replace(part(7), "^([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    source = F.when(part(7) == "", zone).when(part(7) == "Z", "UTC").otherwise(offset)
    digits = F.when(bare.rlike("^[0-9]{10,13}$"), F.substring(bare, 1, 10).try_cast("long"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), digits.cast("decimal(18,6)"))
    return F.when(digits.isNotNull(), epoch).otherwise(F.convert_timezone(source, F.lit("UTC"), local))


def truncated(moment: Column, grain: str, zone: str = "Asia/Shanghai") -> Column:
    """The begin, in ``zone``, of the day, week (Monday), month, quarter or year of a time in UTC."""
    return F.date_trunc(grain, F.convert_timezone(F.lit("UTC"), F.lit(zone), moment))


def hours_since(begin: Column, now: Column) -> Column:
    return days_between(begin, now) * 24
