"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

DAY = 86400.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch(ts) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) AS BIGINT)")


def log1p0(x) -> Column:
    """log(1 + x) of x clamped at 0."""
    return F.log1p(F.greatest(col(x).cast("double"), F.lit(0.0)))


def symlog(x) -> Column:
    x = col(x).cast("double")
    return F.when(x >= 0, 1.0).otherwise(-1.0) * F.log1p(F.abs(x))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def shuffle_key(seed, *parts) -> Column:
    """A reproducible random order: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(p).cast("string") for p in parts)).cast("binary"))


def money(x) -> Column:
    """Cents, so that sums do not depend on order."""
    return col(x).cast("decimal(18,2)")


def now() -> Column:
    """Seconds since 1970 at the start of the query, one value for all of its rows."""
    return F.unix_seconds(F.current_timestamp())


def time_text(seconds, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 as UTC text, whatever the session's zone."""
    return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=col(seconds).cast("decimal(18,6)")), pattern)


def days_between(later, earlier) -> Column:
    """Difference of two times in seconds, in days."""
    return (col(later) - col(earlier)) / F.lit(DAY)
