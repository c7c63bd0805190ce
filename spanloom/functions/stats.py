"""Statistics and predicates that traffic operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SAMPLES = 8
UNWINDOWED = "(unwindowed)"
HOUR = "yyyy-MM-dd'T'HH"


def window_key(start_unix_nano: Column, pattern: str = HOUR) -> Column:
    """The UTC window of a start time; null and 0 give (unwindowed), which sorts first."""
    at = F.timestamp_micros(F.floor(start_unix_nano / 1000))
    return F.when(
        start_unix_nano.isNull() | (start_unix_nano == 0), F.lit(UNWINDOWED)
    ).otherwise(F.date_format(at, pattern))


def aggregate_error(status: Column) -> Column:
    """Error of the aggregates: 'error' or a 5xx-like text; null counts as no error."""
    return F.coalesce((status == "error") | status.startswith("5"), F.lit(False))


def baseline_error(status: Column) -> Column:
    """Error of baselines and regressions: 'error' or a number of 500 or more; null stays."""
    number = F.when(status.rlike(r"^\d+$"), status.try_cast("long"))
    return (status == "error") | F.coalesce(number >= 500, F.lit(False))


def share(flag: Column) -> Column:
    """Share of true among non-null flags; null without any."""
    return F.avg(flag.cast("double"))


def quantiles(value: Column, at: tuple[float, ...], accuracy: int | None = None) -> Column:
    """Percentiles by linear interpolation, or a bounded sketch where accuracy is given."""
    points = F.array(*(F.lit(p) for p in at))
    return F.percentile_approx(value, points, accuracy) if accuracy else F.percentile(value, points)


def percentile_summary(value: Column, prefix: str, accuracy: int | None = None) -> list[Column]:
    """count, p50, p95, p99, min and max of the non-null values, as prefixed columns."""
    value = value.cast("double")
    points = quantiles(value, (0.5, 0.95, 0.99), accuracy)
    return [
        F.count(value).alias(f"{prefix}_count"),
        *(points[i].alias(f"{prefix}_{n}") for i, n in enumerate(("p50", "p95", "p99"))),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
    ]
