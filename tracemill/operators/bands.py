"""One-dimensional banding: a number becomes one of up to eight ordered bands.

The extremes of what is left are scaled to 0 and 1. Twenty boundaries between 0.1 and 0.49 each
propose a low set (at most the boundary) and a high set (at least one minus the boundary). Sets
whose size is close to an even share of what is left are candidates; when none is close enough,
the tolerance grows. The set that is closest (in tenths of a share), and among those the one that
spreads least, takes the lowest or the highest free band.

The value histogram is cut once into about 4,096 runs of neighbouring values at most, and only the moments of
the runs reach the driver. A round adds up whole runs; of a run that a boundary cuts, and only of
those (at most 42), the values are read. Where every run is one value, no round reads anything. The
outcome is a list of at most seven cut points, so banding a table afterwards is a plain expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.ordering import range_segments
from tracemill.storage import written

# Settings of the banding.
MAX_BANDS = 8
BOUNDARY_MIN = 0.1
BOUNDARY_MAX = 0.49
BOUNDARIES = 20
TOLERANCE = 0.45
TOLERANCE_STEP = 0.5

#: Runs that the histogram is cut into, at most; up to so many distinct values, a run is one value.
RUNS = 4096

_STEP = (BOUNDARY_MAX - BOUNDARY_MIN) / (BOUNDARIES - 1)


@dataclass
class _Sum:
    """Totals of a run of values; ``mean`` and ``spread`` are in the scale of its round."""

    weight: int = 0
    values: int = 0
    total: float = 0.0
    squares: float = 0.0
    lowest: float = math.inf
    highest: float = -math.inf

    def plus(self, other: _Sum) -> _Sum:
        return _Sum(
            self.weight + other.weight,
            self.values + other.values,
            self.total + other.total,
            self.squares + other.squares,
            min(self.lowest, other.lowest),
            max(self.highest, other.highest),
        )

    @property
    def spread(self) -> float:
        mean = self.total / self.weight
        # Rounded so that equal spreads stay equal whatever the order of summation.
        return round(math.sqrt(max(self.squares / self.weight - mean * mean, 0.0)), 9)


class _Histogram:
    """Distinct values and their weights, known on the driver by the moments of at most ``runs`` runs.

    Moments are taken about the lowest value of a run, so moving them to the scale of a round only
    adds up what is not negative: nothing cancels.
    """

    def __init__(self, values: DataFrame, column: str, runs: int):
        value = F.col(column).cast("double")
        self.table = written(
            values.where(value.isNotNull() & ~F.isnan(value))
            .groupBy(value.alias("value"))
            .agg(F.expr("count(1) as weight")),
            "histogram",
        )
        head = self.table.limit(runs + 1).collect()
        if len(head) <= runs:
            self.runs = sorted((v, v, 1, w, 0.0, 0.0) for v, w in head)
            return
        parts = range_segments(self.table, ["value"])
        # Within a range, runs of equal length; in all at most half of ``runs``, and one more per range.
        length = F.lit(-(-2 * self.table.count() // runs))
        within = F.row_number().over(Window.partitionBy("seg").orderBy("value")) - 1
        self.table = written(parts.withColumn("run", F.struct("seg", F.floor(within / length))), "histogram")
        first = Window.partitionBy("run")
        about = self.table.withColumn("d", F.col("value") - F.min("value").over(first))
        moments = about.groupBy("run").agg(
            F.min("value").alias("first"),
            F.max("value").alias("last"),
            F.expr("count(1)"),
            F.expr("sum(weight)"),
            F.expr("sum(weight * d)"),
            F.expr("sum(weight * d * d)"),
        )
        self.runs = [tuple(r)[1:] for r in moments.orderBy("first").collect()]

    @property
    def distinct(self) -> int:
        return sum(r[2] for r in self.runs)

    def next_above(self, value: float) -> float:
        """The smallest value above this one."""
        for first, last, *_ in self.runs:
            if first > value:
                return first
            if last > value:
                inside = F.col("value").between(first, last) & (F.col("value") > value)
                return self.table.where(inside).agg(F.min("value")).first()[0]
        raise ValueError(value)

    def proposals(self, lowest: float, highest: float) -> tuple[list[_Sum], list[_Sum], _Sum]:
        """Totals per boundary and side of the values from lowest to highest, nearest edge first."""
        slots: dict[int, _Sum] = {}
        span, cut = highest - lowest, []
        for first, last, count, weight, total, squares in self.runs:
            if last < lowest or first > highest:
                continue
            slot = _slot((first - lowest) / span)
            if first < lowest or last > highest or slot != _slot((last - lowest) / span):
                cut.append((first, last))
                continue
            off = first - lowest
            found = _Sum(
                weight, count, (weight * off + total) / span,
                (weight * off * off + 2 * off * total + squares) / (span * span), first, last,
            )
            slots[slot] = slots.get(slot, _Sum()).plus(found)
        if cut:
            for slot, *sums in self._read(cut, lowest, highest):
                slots[slot] = slots.get(slot, _Sum()).plus(_Sum(*sums))
        low = [slots.get(i + 1, _Sum()) for i in range(BOUNDARIES)]
        high = [slots.get(-(i + 1), _Sum()) for i in range(BOUNDARIES)]
        return low, high, slots.get(0, _Sum())

    def _read(self, cut: list[tuple[float, float]], lowest: float, highest: float) -> list:
        """One row per slot of the values in these runs."""

        def boundary(distance: str) -> str:
            steps = f"ceil(({distance} - {BOUNDARY_MIN!r}D) / {_STEP!r}D) + 1"
            return f"greatest(1, least({steps}, {BOUNDARIES}))"

        inside = reduce(Column.__or__, (F.col("value").between(*ends) for ends in cut))
        return (
            self.table.where(F.col("value").between(lowest, highest) & inside)
            .selectExpr("value", "weight", f"(value - {lowest!r}D) / ({highest!r}D - {lowest!r}D) as x")
            .selectExpr(
                "*",
                f"""case when x <= {BOUNDARY_MAX!r}D then {boundary('x')}
                    when 1D - x <= {BOUNDARY_MAX!r}D then -{boundary('(1D - x)')} else 0 end as slot""",
            )
            .groupBy("slot")
            .agg(
                F.expr("sum(weight)"),
                F.expr("count(1)"),
                F.expr("sum(weight * x)"),
                F.expr("sum(weight * x * x)"),
                F.expr("min(value)"),
                F.expr("max(value)"),
            )
            .collect()
        )


def _slot(x: float) -> int:
    """The smallest boundary that covers a scaled value: 1, 2, .. from below, -1, -2, .. from above, or 0."""
    for distance, sign in ((x, 1), (1.0 - x, -1)):
        if distance <= BOUNDARY_MAX:
            return sign * max(1, min(math.ceil((distance - BOUNDARY_MIN) / _STEP) + 1, BOUNDARIES))
    return 0


def band_cuts(values: DataFrame, column: str, max_bands: int = MAX_BANDS, runs: int = RUNS) -> list[float]:
    """Lower edges of bands 1, 2, ..: a value is in band k when k of them are at most the value."""
    histogram = _Histogram(values, column, runs)
    left, bands = histogram.distinct, max_bands
    if left <= max_bands:
        return sorted(v for (v,) in histogram.table.select("value").collect())[1:]
    lowest, highest = histogram.runs[0][0], histogram.runs[-1][1]
    cuts_low, cuts_high = [], []
    while bands > 1:
        low, high, middle = histogram.proposals(lowest, highest)
        share = _total([*low, *high, middle]).weight / bands
        chosen = _choose(low, high, share, most_values=left - (bands - 1))
        if chosen is None:
            lowest = histogram.next_above(lowest)
            cuts_low.append(lowest)
            left -= 1
        else:
            side, count = chosen
            taken = _total((low if side == "low" else high)[:count])
            if side == "low":
                lowest = _total([*low[count:], middle, *high]).lowest
                cuts_low.append(lowest)
            else:
                highest = _total([*high[count:], middle, *low]).highest
                cuts_high.append(taken.lowest)
            left -= taken.values
        bands -= 1
    return cuts_low + cuts_high[::-1]


def band_of(column: Column | str, cuts: list[float]) -> Column:
    """The band of a value, from 0, as a double."""
    value = F.col(column) if isinstance(column, str) else column
    value = value.cast("double")
    band = F.lit(0.0)
    for cut in cuts:
        band = band + F.when(value >= F.lit(float(cut)), 1.0).otherwise(0.0)
    return F.when(value.isNotNull(), band)


def frequency_bands(
    df: DataFrame, column: str, max_bands: int = MAX_BANDS, out: str = "band"
) -> DataFrame:
    """``df`` with the band of ``column`` in ``out``."""
    return df.withColumn(out, band_of(column, band_cuts(df, column, max_bands)))


def _total(sums: list[_Sum]) -> _Sum:
    return reduce(_Sum.plus, sums, _Sum())


def _choose(low: list[_Sum], high: list[_Sum], share: float, most_values: int):
    """Side and number of boundaries of the best set, or None when all leave too few values."""
    candidates = []
    for side, sets in (("low", low), ("high", high)):
        running = _Sum()
        for count, s in enumerate(sets, start=1):
            running = running.plus(s)
            if 0 < running.values <= most_values:
                candidates.append((abs(running.weight - share) / share, running.spread, side, count))
    if not candidates:
        return None
    tolerance = TOLERANCE
    while not any(c[0] <= tolerance for c in candidates):
        tolerance += TOLERANCE_STEP
    fitting = [c for c in candidates if c[0] <= tolerance]
    _, _, side, count = min(
        fitting, key=lambda c: (round(c[0], 1), c[1], c[2] != "low", c[3])
    )
    return side, count
