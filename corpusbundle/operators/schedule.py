"""Politeness schedule: the earliest time each request may run under a token bucket."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbundle.operators.ordering import (
    SLICE,
    earlier_slices,
    join_slices,
    slice_by_order,
    within_slice,
)

# Default pace of one request per second with bursts of three.
DEFAULT_RATE = 1.0
DEFAULT_BURST = 3

# Rates are taken as fractions with denominators up to this one.
FINEST_RATE = 1_000_000


def throttle_schedule(
    requests: DataFrame,
    key: str | None,
    arrival_us: str,
    tie: str,
    rate: float | Fraction = DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    slices: int | None = None,
) -> DataFrame:
    """Add ``admit_us`` and ``wait_us`` for a first-come token bucket per ``key``.

    The bucket starts full with ``burst`` tokens and gains ``rate`` per second.
    With interval T, the k-th request (from 0) of a key is admitted at
    max(a_k, max over j <= k of (a_j - j*T) + (k + 1 - burst)*T). The running
    maximum is kept per slice and combined across slices, so one hot key, or the
    single shared bucket of ``key=None``, is spread over many tasks.

    All times are kept as whole multiples of 1/n microseconds, where n is the rate's
    numerator, so that no interval is rounded; ``admit_us`` is the first whole microsecond
    at or after the exact time.
    """
    if rate <= 0 or burst <= 0:
        raise ValueError("rate and burst must be positive")
    exact = Fraction(rate).limit_denominator(FINEST_RATE)
    if exact == 0:
        raise ValueError(f"rate is below 1/{FINEST_RATE} per second")
    wide = "decimal(38,0)"
    units = F.lit(exact.numerator).cast("decimal(18,0)")
    interval = F.lit(1_000_000 * exact.denominator).cast("decimal(18,0)")
    keys = [key] if key else []
    order = [arrival_us, tie]

    sliced = slice_by_order(requests, keys, order, slices)
    within = within_slice(keys, order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        sliced.withColumn("_at", (F.row_number().over(within) - 1).cast("long"))
        .withColumn("_slack", (F.col(arrival_us) * units - F.col("_at") * interval).cast(wide))
        .withColumn("_peak", F.max("_slack").over(so_far))
    )
    earlier = earlier_slices(keys)
    starts = (
        local.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_slack").alias("_top"))
        .withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))
        .withColumn("_prior", F.max((F.col("_top") - F.col("_n0") * interval).cast(wide)).over(earlier))
        .select(*keys, SLICE, "_n0", "_prior")
    )
    peak = F.greatest((F.col("_peak") - F.col("_n0") * interval).cast(wide), F.col("_prior"))
    turn = F.col("_n0") + F.col("_at")
    due = (peak + (turn + 1 - burst) * interval).cast(wide)
    # Whole microseconds, rounded up; div truncates towards zero.
    whole = F.call_function("div", due, units)
    ready = F.when(whole * units < due, whole + 1).otherwise(whole)
    return (
        join_slices(local, starts, keys)
        .withColumn("admit_us", F.greatest(F.col(arrival_us), ready.cast("long")))
        .withColumn("wait_us", F.col("admit_us") - F.col(arrival_us))
        .select(*requests.columns, "admit_us", "wait_us")
    )
