"""Calendar labels for the order-timing counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def period_day(ts) -> Column:
    """Night < 06:00 <= Morning < 12:00 <= Afternoon < 18:00 <= Evening."""
    h = F.hour(_c(ts))
    return (F.when(h < 6, "Night").when(h < 12, "Morning").when(h < 18, "Afternoon")
            .otherwise("Evening"))


def weekday_weekend(d) -> Column:
    """Monday..Friday -> Weekday, Saturday/Sunday -> Weekend (B25). ``weekday`` is 0 on Monday."""
    return F.when(F.weekday(_c(d)) < 5, "Weekday").otherwise("Weekend")


def month_name(ts) -> Column:
    return F.date_format(_c(ts), "MMMM")


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def hour_band(ts) -> Column:
    """'HH-HH' band, e.g. 23 -> '23-24' (B26)."""
    h = F.hour(_c(ts))
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit("-"), F.lpad((h + 1).cast("string"), 2, "0"))


def calendar_labels(df, ts: str):
    """Month / weekday / hour labels plus their numbers, so ordering never depends on text."""
    return df.withColumns({
        "month": month_name(ts), "month_num": F.month(_c(ts)),
        "weekday": weekday_name(ts), "weekday_num": F.weekday(_c(ts)),
        "hour": hour_band(ts), "hour_num": F.hour(_c(ts)),
        "period_day": period_day(ts), "weekday_weekend": weekday_weekend(ts),
    })
