"""Display formatting (Korean date captions, cell values) as Column expressions.

Naive timestamps are taken as Korea Standard Time (no shift); zoned values
are converted to KST.  KST has had a fixed +09:00 offset since 1988.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KST = "Asia/Seoul"
_KST_OFFSET_MIN = 9 * 60

# ISO-8601 text accepted by the display path: date 'T' HH:MM[:SS[.ffffff]]
# with an optional 'Z' or ±HH:MM offset, every part in its range.
_ISO_RE = (r"^(\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))T((?:[01]\d|2[0-3]):[0-5]\d)"
           r"(?::[0-5]\d(?:\.\d{1,6})?)?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$")


def format_timestamp_ntz(c: Column) -> Column:
    """'Y년 M월 D일 HH:MM' built from date parts: wall-clock values are never
    routed through the session time zone."""
    return F.concat(format_date(c), F.lit(" "), F.lpad(F.hour(c).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(F.minute(c).cast("string"), 2, "0"))


def format_timestamp_ltz(c: Column) -> Column:
    """Zoned instant → KST wall clock → caption."""
    wall = F.convert_timezone(F.current_timezone(), F.lit(KST), c.cast("timestamp_ntz"))
    return format_timestamp_ntz(wall)


def format_date(c: Column) -> Column:
    """'Y년 M월 D일' from date parts (zone-free for DATE and TIMESTAMP_NTZ)."""
    return F.concat(F.year(c).cast("string"), F.lit("년 "), F.month(c).cast("string"), F.lit("월 "),
                    F.dayofmonth(c).cast("string"), F.lit("일"))


# The caption of an ISO text, as an SQL lambda: it is parsed as a whole, where the same tree of Column calls for
# every text cell of a wide table would take longer to build than to run.  One pattern test (and only on text
# that has a 'T' at all); the parts then stand at fixed places; the time is bound once as ``k``.
_ISO_CAPTION = f"""v -> coalesce(transform(array(CASE WHEN instr(v, 'T') > 0 AND v RLIKE r'{_ISO_RE}' THEN
    try_cast(concat(substr(v, 1, 10), ' ', substr(v, 12, 5)) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0,
        CASE WHEN endswith(v, 'Z') THEN {_KST_OFFSET_MIN}
             WHEN substr(v, -6, 1) IN ('+', '-') THEN {_KST_OFFSET_MIN} - (CASE substr(v, -6, 1) WHEN '-' THEN -1 ELSE 1 END)
                  * (try_cast(substr(v, -5, 2) AS INT) * 60 + try_cast(substr(v, -2) AS INT))
             ELSE 0 END) END),
    k -> concat(year(k), '년 ', month(k), '월 ', day(k), '일 ', lpad(hour(k), 2, '0'), ':', lpad(minute(k), 2, '0')))[0], v)"""


def format_iso_text(c: Column) -> Column:
    """Text holding an ISO-8601 date-time → KST caption; any other text
    (including NULL, and days a month does not have) unchanged."""
    return F.call_function("transform", F.array(c), F.expr(_ISO_CAPTION))[0]


def format_datetime(c: Column, dtype: T.DataType) -> Column:
    """Caption for one value of the given type (strings: ISO text only)."""
    if isinstance(dtype, T.TimestampNTZType):
        return format_timestamp_ntz(c)
    if isinstance(dtype, T.TimestampType):
        return format_timestamp_ltz(c)
    if isinstance(dtype, T.DateType):
        return format_date(c)
    if isinstance(dtype, T.StringType):
        return format_iso_text(c)
    return c.cast("string")


def decimal_display(c: Column) -> Column:
    """Plain decimal text without trailing zeros; integral → integer text."""
    plain = F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(plain)


def cell_display(c: Column, dtype: T.DataType) -> Column:
    """One cell for display; keeps the type unless formatting applies."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return format_datetime(c, dtype)
    if isinstance(dtype, T.DecimalType):
        return decimal_display(c)
    if isinstance(dtype, T.StringType):
        return format_iso_text(c)
    return c


def format_cells(df: DataFrame, skip_suffix: str = "_sha256") -> DataFrame:
    """Apply ``cell_display`` to every column except hash side-cars."""
    return df.select(*[
        F.col(f.name) if f.name.endswith(skip_suffix)
        else cell_display(F.col(f.name), f.dataType).alias(f.name)
        for f in df.schema.fields
    ])


def drop_hashes(df: DataFrame, suffix: str = "_sha256") -> DataFrame:
    return df.select(*[n for n in df.columns if not n.endswith(suffix)])


def krw(c: Column) -> Column:
    """Money caption: '₩' + thousands-separated whole amount."""
    return F.concat(F.lit("₩"), F.format_number(c, 0))


def blood_pressure_text(systolic: Column, diastolic: Column) -> Column:
    """'sys/dia' with a missing side shown empty."""
    return F.concat(F.coalesce(systolic.cast("string"), F.lit("")), F.lit("/"),
                    F.coalesce(diastolic.cast("string"), F.lit("")))


def chart_order(values: Column) -> Column:
    """Bar charts list the largest first from the bottom: reversed arrays."""
    return F.reverse(values)
