"""Channel geometry from station/elevation arrays, row by row and without Python.

Values that a lambda needs more than once are bound with :func:`let`. Written out instead, they would be evaluated
again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ELEVATION = 100.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_elevations(elevations: Column, threshold: float = MAX_ELEVATION) -> Column:
    """Replace elevations above the threshold by the mean of their neighbours, from first to last.

    A replaced value feeds the next replacement. At either end the only neighbour is copied. Arrays without such
    values, nearly all of them, are returned as they are.
    """

    def repaired(values: Column) -> Column:
        last = F.size(values) - 1

        def next_value(done: Column, i: Column) -> Column:
            here, before, after = F.get(values, i), F.get(done, i - 1), F.get(values, i + 1)
            mean = F.coalesce((before + after) / 2, before, after)
            return F.when(here > threshold, F.when(i == last, before).otherwise(mean)).otherwise(here)

        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.array().cast("array<double>"),
            lambda done, i: F.concat(done, F.array(next_value(done, i))),
        )

    return let(
        elevations, lambda v: F.when(F.exists(v, lambda y: y > threshold), repaired(v)).otherwise(v)
    )


def area_below(points: Column, depth: Column) -> Column:
    """Area between a level and the bed, by trapezoids over points ``(x, Y)`` in x order; never negative."""

    def area(ordered: Column) -> Column:
        def slab(i: Column) -> Column:
            a, b = F.get(ordered, i - 1), F.get(ordered, i)
            return (b["x"] - a["x"]) * (depth - (a["Y"] + b["Y"]) / 2)

        steps = F.when(F.size(ordered) > 1, F.sequence(F.lit(1), F.size(ordered) - 1))
        return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, i: s + slab(i)), F.lit(0.0))

    wet = F.filter(points, lambda p: p["Y"] <= depth)
    by_station = F.array_sort(
        F.transform(wet, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["Y"].alias("Y")))
    )
    return F.greatest(F.lit(0.0), let(by_station, area))


def channel_between(points: Column, left: Column, right: Column) -> Column:
    """The points between two stations, their elevations cleaned."""

    def cleaned(inside: Column) -> Column:
        elevations = clean_elevations(F.transform(inside, lambda p: p["Y"]))
        return F.zip_with(inside, elevations, lambda p, y: F.struct(p["x"].alias("x"), y.alias("Y")))

    return let(F.filter(points, lambda p: (p["x"] >= left) & (p["x"] <= right)), cleaned)


def channel_shape(channel: Column) -> Column:
    """Struct of point count ``n``, depth ``Ym``, top width ``TW``, area ``A`` and ``r = A / (Ym * TW - A)``."""

    def shape(points: Column) -> Column:
        elevations = F.transform(points, lambda p: p["Y"])
        stations = F.transform(points, lambda p: p["x"])
        measured = F.struct(
            F.size(points).alias("n"),
            F.array_max(elevations).alias("top"),
            F.array_min(elevations).alias("bottom"),
            (F.array_max(stations) - F.array_min(stations)).alias("TW"),
        )

        def with_area(m: Column) -> Column:
            depth = m["top"] - m["bottom"]
            area = area_below(points, m["top"])
            return let(F.struct(depth.alias("Ym"), area.alias("A"), (depth * m["TW"]).alias("box")), lambda s: finish(m, s))

        return let(measured, with_area)

    def finish(m: Column, s: Column) -> Column:
        rest = s["box"] - s["A"]
        infinite = F.when(s["A"] > 0, F.lit(float("inf"))).otherwise(float("nan"))
        r = F.when(rest != 0, F.try_divide(s["A"], rest)).otherwise(infinite)
        return F.struct(m["n"].alias("n"), s["Ym"].alias("Ym"), m["TW"].alias("TW"), s["A"].alias("A"), r.alias("r"))

    return let(channel, shape)
