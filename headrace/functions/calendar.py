"""Hour-of-year calendar: hour 0 is January 1, 00:00."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headrace.functions.core import ColumnLike, col


def is_leap(year: ColumnLike) -> Column:
    y = col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def hours_in_year(year: ColumnLike) -> Column:
    return F.when(is_leap(year), F.lit(8784)).otherwise(F.lit(8760))


def hour_of_year(ts: ColumnLike) -> Column:
    return ((F.dayofyear(col(ts)) - 1) * 24 + F.hour(col(ts))).cast("int")


def day_of_year(hoy: ColumnLike) -> Column:
    return (F.floor(col(hoy) / 24) + 1).cast("int")


def date_of(year: ColumnLike, hoy: ColumnLike) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), F.floor(col(hoy) / 24).cast("int"))


def month_of(year: ColumnLike, hoy: ColumnLike) -> Column:
    return F.month(date_of(year, hoy))


def julian_date(year: ColumnLike, jday: ColumnLike) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), (col(jday) - 1).cast("int"))


def days_in_month(year: ColumnLike, month: ColumnLike) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(col(year), col(month), F.lit(1))))


def season(month: ColumnLike, lat: ColumnLike) -> Column:
    """X-4: season by month, flipped south of the equator; unknown latitude is north."""
    m = col(month)
    north = (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )
    south = (
        F.when(m.isin(12, 1, 2), "summer").when(m.isin(3, 4, 5), "autumn")
        .when(m.isin(6, 7, 8), "winter").otherwise("spring")
    )
    return F.when(F.coalesce(col(lat) < 0, F.lit(False)), south).otherwise(north)


def cyclic_features(hour: ColumnLike, doy: ColumnLike) -> list[Column]:
    """X-5: sine and cosine of the hour and the day of the year."""
    h, d = 2 * F.pi() * col(hour) / 24.0, 2 * F.pi() * col(doy) / 365.25
    return [F.sin(h).alias("sin_hour"), F.cos(h).alias("cos_hour"),
            F.sin(d).alias("sin_doy"), F.cos(d).alias("cos_doy")]
