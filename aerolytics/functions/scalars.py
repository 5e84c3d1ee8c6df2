from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def am_or_pm(hhmm: Column | str) -> Column:
    """AM when the first two characters are an hour below 12, else PM (2400 is PM); null when unreadable."""
    hour = F.substring(_col(hhmm), 1, 2).try_cast("int")
    return F.when(hour < 12, F.lit("AM")).when(hour.isNotNull(), F.lit("PM"))


def hhmm_pretty(hhmm: Column | str) -> Column:
    """HHMM as HH:MM; null for fewer than four characters."""
    c = _col(hhmm)
    return F.when(F.length(c) >= 4, F.concat(F.substring(c, 1, 2), F.lit(":"), F.substring(c, 3, 2)))


def parse_double(text: Column | str) -> Column:
    """The number, or null for anything that is not one. NaN and infinities count as malformed."""
    x = F.trim(_col(text)).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_long(text: Column | str) -> Column:
    return F.trim(_col(text)).try_cast("bigint")


def strip_quotes(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit('"'), F.lit(""))


def two_decimals(x: Column | str) -> Column:
    """Fixed two decimals, half up, as text."""
    return F.format_string("%.2f", _col(x))


def cents_half_up(total: Column, n: Column) -> Column:
    """total / n in hundredths, rounded half up on the exact rational; exact for whole totals."""
    return (F.sign(total) * F.floor((200 * F.abs(total) + n) / (2 * n))).cast("bigint")
