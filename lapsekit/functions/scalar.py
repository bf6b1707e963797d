"""Column expressions for the preparation steps (B-series).

Everything here returns a ``Column`` (or a DataFrame with added columns) built from
``pyspark.sql.functions`` only, so it stays inside whole-stage codegen. Divisions use
``try_divide`` because the session runs with ANSI mode on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- B1, B31: ISO text -> date / time / timestamp -------------------------------------------------

def iso_to_timestamp(text) -> Column:
    """'2021-03-04T05:06:07.123456Z' -> timestamp 2021-03-04 05:06:07 (fraction dropped).

    Works with and without a fraction; unparsable text gives null instead of an error.
    """
    no_fraction = F.substring_index(F.regexp_replace(_c(text), "T", " "), ".", 1)
    return F.try_to_timestamp(F.regexp_replace(no_fraction, "Z$", ""))


def split_iso_ts(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_date`` (date), ``{prefix}_time`` ('HH:mm:ss') and ``{prefix}_datetime``."""
    ts = iso_to_timestamp(col)
    return df.withColumns({
        f"{prefix}_datetime": ts,
        f"{prefix}_date": ts.cast("date"),
        f"{prefix}_time": F.date_format(ts, "HH:mm:ss"),
    })


def combine_ts(date, time) -> Column:
    """Date + 'HH:mm:ss' text -> timestamp."""
    return F.try_to_timestamp(F.concat_ws(" ", _c(date).cast("string"), _c(time)))


# --- B2, B6, B7, B8: fills ---------------------------------------------------------------------

def fill_from(col, other) -> Column:
    """Null -> value of another column (B2)."""
    return F.coalesce(_c(col), _c(other))


def fill_by_regex(col, src, pattern: str, default: str) -> Column:
    """Null -> first regex group found in ``src``, else ``default``."""
    found = F.nullif(F.regexp_extract(_c(src), pattern, 1), F.lit(""))
    return F.coalesce(_c(col), found, F.lit(default))


def fill_when(col, cond: Column, value) -> Column:
    """Null and ``cond`` -> constant (B7). Apply several in the order given."""
    return F.when(_c(col).isNull() & cond, F.lit(value)).otherwise(_c(col))


def since(df: DataFrame, col: str, date: str = "2020-01-01") -> DataFrame:
    """Rows on or after a date floor (B5); a plain filter, pushed down to the Parquet scan."""
    return df.where(F.col(col) >= F.lit(date).cast("date"))


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant fill per column (B8). Columns are cast to text first when the fill is text and the
    column is not (the reference fills a numeric ``year`` with 'unknown')."""
    casts = {c: F.col(c).cast("string") for c, v in values.items()
             if isinstance(v, str) and not isinstance(df.schema[c].dataType, T.StringType)}
    return df.withColumns(casts).na.fill(dict(values)) if casts else df.na.fill(dict(values))


# --- B3, B4, B10: encodings ----------------------------------------------------------------------

def encode_map(col, mapping: Mapping) -> Column:
    """Fixed value -> code map; values outside the map give null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(col))


def encode_sorted(df: DataFrame, col: str, out: str) -> DataFrame:
    """Code = position of the value among the sorted distinct values, from 0.

    Meant for categorical columns: the distinct set is small, so its ordering costs nothing,
    and the code table joins back without a size hint (AQE broadcasts it when it is small).
    """
    from lapsekit.operators.rank import running_total
    codes = running_total(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], None, out=out)
    codes = codes.withColumn(out, (F.col(out) - 1).cast("int"))
    return df.join(codes, on=col, how="left")


def one_hot(df: DataFrame, col: str, prefix: str | None, values: Sequence, sep: str = "_") -> DataFrame:
    """One 0/1 column per listed value (B10): the columns are the caller's choice, not the data's."""
    return df.withColumns({one_hot_name(v, prefix, sep): F.when(F.col(col) == F.lit(v), 1).otherwise(0)
                           for v in values})


def one_hot_name(value, prefix: str | None = None, sep: str = "_") -> str:
    """Column name for a one-hot value: non-word characters become '_' (e.g. 'Promo_4_NOT_SPECIFIED')."""
    import re
    v = re.sub(r"\W+", "_", str(value)).strip("_")
    return f"{prefix}{sep}{v}" if prefix else v


# --- B11: list-of-dict text -> rows ---------------------------------------------------------------

def parse_list_text(col, element: T.DataType) -> Column:
    """Parse JSON or Python-literal list text. Bad text -> null; ``None`` literals -> null fields."""
    fixed = F.regexp_replace(_c(col), r":\s*None(\s*[,}\]])", ": null$1")
    return F.from_json(fixed, T.ArrayType(element) if not isinstance(element, T.ArrayType) else element)


def explode_items(df: DataFrame, col: str, element: T.StructType, keep: Sequence[str]) -> DataFrame:
    """One row per list element, fields flattened; the row key stays on every item row."""
    parsed = df.select(*keep, F.explode_outer(parse_list_text(col, element)).alias("_item"))
    return parsed.select(*keep, *[F.col(f"_item.{f.name}").alias(f.name) for f in element.fields])


# --- money ---------------------------------------------------------------------------------------

MONEY = "decimal(18,4)"


def money(col) -> Column:
    """Money as an exact 4-place decimal (sums of doubles depend on the summation order)."""
    return _c(col).cast(MONEY)


def money_sum(col) -> Column:
    """Exact sum of money, returned as double: the same value for any partitioning."""
    return F.sum(money(col)).cast("double")


def money_avg(col, places: int = 2) -> Column:
    """Mean of money rounded half-up to ``places`` (the reference rounds AOV to cents)."""
    return F.round(F.avg(money(col)), places).cast("double")


# --- B12, B19-B23: arithmetic --------------------------------------------------------------------

def line_amount(price="item_price", qty="quantity", promo="promo_amount", fee="shipment_fee") -> Column:
    """price * qty - promo + fee."""
    return _c(price) * _c(qty) - F.coalesce(_c(promo), F.lit(0.0)) + F.coalesce(_c(fee), F.lit(0.0))


def safe_ratio(x, d) -> Column:
    """x when d = 0 and x > 0; x / d when d > 0; otherwise 0."""
    x, d = _c(x), _c(d)
    return (F.when((d == 0) & (x > 0), x.cast("double"))
            .when(d > 0, F.try_divide(x, d))
            .otherwise(F.lit(0.0)))


def ratio_or_zero(x, d) -> Column:
    """x / d, and 0 for a zero or null denominator."""
    return F.coalesce(F.try_divide(_c(x), _c(d)), F.lit(0.0))


def row_sum(cols: Iterable) -> Column:
    """Row-wise sum (B20); nulls count as 0 like pandas ``sum(axis=1)``."""
    return reduce(add, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def row_mean(cols: Sequence) -> Column:
    return row_sum(cols) / F.lit(len(cols))


def planar_distance(lat, lon, center_lat: float, center_lon: float) -> Column:
    """Euclidean distance in degrees to a fixed point."""
    return F.sqrt(F.pow(_c(lat) - F.lit(center_lat), 2) + F.pow(_c(lon) - F.lit(center_lon), 2))


def log1p(col) -> Column:
    return F.log1p(_c(col))


# --- B16-B18: calendar arithmetic ---------------------------------------------------------------

def age_years(birth, as_of) -> Column:
    """Whole years from ``birth`` to ``as_of``: year difference, minus 1 before the birthday."""
    b, a = _c(birth), _c(as_of)
    before_birthday = (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b)))
    return (F.year(a) - F.year(b) - F.when(before_birthday, 1).otherwise(0)).cast("int")


def full_months(start, end) -> Column:
    """Whole calendar months from ``start`` to ``end``, the way ``relativedelta`` counts."""
    s, e = _c(start).cast("date"), _c(end).cast("date")
    m = (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))
    return (F.when((m > 0) & (F.add_months(s, m) > e), m - 1)
            .when((m < 0) & (F.add_months(s, m) < e), m + 1)
            .otherwise(m)).cast("int")


def ship_days(ship, placed) -> Column:
    """Days from booking to shipment; negative values are kept."""
    return F.datediff(_c(ship).cast("date"), _c(placed).cast("date"))


# --- B27-B32: small row steps ---------------------------------------------------------------------

def clean_item(col) -> Column:
    return F.lower(F.trim(_c(col)))


def presence(cnt) -> Column:
    """Count -> 0/1 flag."""
    return (_c(cnt) >= 1).cast("int")


def itemset_str(arr) -> Column:
    """Item set -> 'a, b, c' in sorted order."""
    return F.concat_ws(", ", F.array_sort(_c(arr)))
