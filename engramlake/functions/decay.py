"""The forgetting curve and its reinforcement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def retrievability(days: Column, stability: Column, p: Params = Params()) -> Column:
    """Chance to recall after days: 1 for stability <= 0, NaN where the curve is undefined (access far in the future)."""
    d = p.decay_exponent
    f = p.retrievability_factor ** (1 / d) - 1
    base = 1 + F.lit(f) * days / F.when(stability > 0, stability)
    r = F.when(base < 0, F.lit(float("nan"))).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(F.when(base > 0, base).otherwise(F.lit(1e-12)), F.lit(d))))
    )
    return F.when(stability <= 0, F.lit(1.0)).otherwise(r)


def reinforced(stability: Column, r: Column, p: Params = Params()) -> Column:
    """Stability after an access at retrievability r: it grows more, the more was forgotten."""
    return stability * (1 + F.lit(p.growth_factor) * (1 - r))


def stability_fold(times: Column, start: Column, stability: Column, p: Params = Params()) -> Column:
    """Stability after the accesses of a sorted array of timestamps, starting from the time `start`."""
    first = F.struct(start.alias("t"), stability.cast("double").alias("s"))
    step = lambda a, t: F.struct(
        t.alias("t"), reinforced(a["s"], retrievability(days_between(t, a["t"]), a["s"], p), p).alias("s")
    )
    return F.aggregate(times, first, step, lambda a: a["s"])
