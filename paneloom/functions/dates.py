"""Date parsing, calendar anchors and lags on time-zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text layouts after ISO, tried in this order.
DAY_LAYOUTS = ("yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd")
PARTIAL_LAYOUTS = ("yyyy-M", "yyyy")


def parse_timestamp(text: Column, partial: bool = True) -> Column:
    """ISO text first, then the registered layouts; unparseable text is null.

    A zone offset is applied, giving UTC. ``partial`` also accepts a year or a year and month.
    """
    value = F.trim(text)
    zoned = value.rlike(r"^\d{4}-.*\d(Z|[+-]\d{2}:?\d{2})$") & value.rlike("[T ]")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz"))
    iso = F.when(zoned, utc).when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), value.try_cast("timestamp_ntz"))
    layouts = DAY_LAYOUTS + (PARTIAL_LAYOUTS if partial else ())
    return F.coalesce(iso, *[F.try_to_timestamp(value, F.lit(p)).cast("timestamp_ntz") for p in layouts])


def year_of(text: Column, low: int = 1900, high: int = 2200) -> Column:
    """Integer year from integer text inside the plausible range, else null."""
    year = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int"))
    return F.when(year.between(low, high), year)


def anchor(year: Column, month: int, day: int, shift: int = 0) -> Column:
    return F.make_timestamp_ntz(year + shift, F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))


def add_months(moment: Column, months: Column | int) -> Column:
    """Month shift that keeps the time of day and clamps to the month end."""
    count = F.lit(months) if isinstance(months, int) else months
    return moment + F.make_ym_interval(F.lit(0), count)


def calendar_days(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(later), F.to_date(earlier))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored, so a negative lag moves away from zero."""

    def time_of_day(moment: Column) -> Column:
        return moment - moment.cast("date").cast("timestamp_ntz")

    behind = F.when(time_of_day(later) < time_of_day(earlier), 1).otherwise(0)
    return calendar_days(later, earlier) - behind


def year_complete(year: Column, through: int, incomplete: tuple[int, ...] = ()) -> Column:
    ok = year <= through
    return ok & ~year.isin(*incomplete) if incomplete else ok
