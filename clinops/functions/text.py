"""String helpers and personal-data masks as native Column expressions.

Each mask takes and returns a ``Column`` so a whole table is masked in one
``select`` that stays inside whole-stage codegen — no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode whitespace at both ends; Spark's trim()
# removes only spaces.  (?U) makes \s Unicode-aware in Java regex.
_STRIP_RE = r"(?U)^\s+|\s+$"


def ustrip(c: Column) -> Column:
    """``str.strip()`` parity (all Unicode whitespace, both ends)."""
    return F.regexp_replace(c, _STRIP_RE, "")


def sha256_hex(c: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text (NULL stays NULL)."""
    return F.sha2(c.cast("string"), 256)


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_name(c: Column) -> Column:
    """First character then stars; one character gets one star; blank unchanged."""
    v = ustrip(c)
    n = F.length(v)
    return (F.when(v == "", c)
            .when(n == 1, F.concat(v, F.lit("*")))
            .otherwise(F.concat(F.substring(v, 1, 1), _stars(n - 1))))


def mask_rrn(c: Column) -> Column:
    """Resident number: first 8 characters then six stars (first 1 if shorter)."""
    v = ustrip(c)
    return (F.when(v == "", c)
            .when(F.length(v) >= 8, F.concat(F.substring(v, 1, 8), F.lit("******")))
            .otherwise(F.concat(F.substring(v, 1, 1), F.lit("******"))))


def mask_text(c: Column) -> Column:
    """Free text: first two characters then stars; up to two: first + one star."""
    v = ustrip(c)
    n = F.length(v)
    return (F.when(v == "", c)
            .when(n <= 2, F.concat(F.substring(v, 1, 1), F.lit("*")))
            .otherwise(F.concat(F.substring(v, 1, 2), _stars(n - 2))))


def mask_email(c: Column) -> Column:
    """Split on the first '@': first local character + '***@' + domain.

    Without '@' the stripped value goes through the name mask.
    """
    v = ustrip(c)
    at = F.instr(v, "@")
    local = F.substring_index(v, "@", 1)
    domain = v.substr(at + 1, F.length(v))
    return (F.when(at == 0, mask_name(v))
            .when(local == "", F.concat(F.lit("***@"), domain))
            .otherwise(F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)))


def mask_phone(c: Column) -> Column:
    """First 3 + '****' + last 4; four characters or fewer become all stars."""
    v = ustrip(c)
    n = F.length(v)
    return (F.when(n <= 4, _stars(n))
            .otherwise(F.concat(F.substring(v, 1, 3), F.lit("****"), F.right(v, F.lit(4)))))


def mask_address(c: Column) -> Column:
    """First two raw characters + '***'; empty unchanged."""
    return F.when(c == "", c).otherwise(F.concat(F.substring(c, 1, 2), F.lit("***")))


def mask_id(c: Column) -> Column:
    """Identifier of any type: '***' + last two characters of its text."""
    s = c.cast("string")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.length(s) >= 2, F.concat(F.lit("***"), F.right(s, F.lit(2))))
            .otherwise(F.lit("***")))


def mask_numeric_id(c: Column) -> Column:
    """Wearable-side id mask: stripped text, blank becomes NULL."""
    s = ustrip(c.cast("string"))
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("string"))
            .when(F.length(s) >= 2, F.concat(F.lit("***"), F.right(s, F.lit(2))))
            .otherwise(F.lit("***")))


def truncate(c: Column, n: int) -> Column:
    """First ``n`` characters (Python ``s[:n]``)."""
    return F.substring(c, 1, n)
