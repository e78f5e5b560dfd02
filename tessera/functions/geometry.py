"""Pyramid levels, patch geometry and polygons as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def optimal_level(ds: Column, target: Column) -> Column:
    """struct(level, extra): the level to read for a downsample, and what is left to scale.

    A level within 0.01 serves as it is. Else the last of the leading levels
    that do not exceed the target, or the first one if the target is finer
    than all. ``extra`` is at least 1.
    """
    index = F.sequence(F.lit(0), F.size(ds) - 1)
    near = F.get(F.filter(index, lambda i: F.abs(F.get(ds, i) - target) < 0.01), F.lit(0))
    above = F.filter(index, lambda i: F.get(ds, i) > target)
    last = F.coalesce(F.get(above, F.lit(0)), F.size(ds)) - 1
    first = F.get(F.filter(index, lambda i: F.get(ds, i) >= target), F.lit(0))
    coarser = target >= F.get(ds, F.lit(0))
    level = F.coalesce(near, F.when(coarser, last).otherwise(first))
    extra = F.when(near.isNotNull(), F.lit(1.0)).when(coarser, target / F.get(ds, last)).otherwise(F.get(ds, first) / target)
    return F.when(F.size(ds) > 0, F.struct(level.cast("bigint").alias("level"), extra.alias("extra")))


def geometry_error(mag: Column, target_mag: Column) -> Column:
    return F.when(mag.isNull(), F.lit("magnification unknown")).when(target_mag > mag, F.lit("target above base magnification"))


def patch_geometry(ds: Column, mag: Column, target_mag: Column, patch: Column, step: Column) -> Column:
    """struct(level, patch_src, step_src, patch_l0, read) of patches at a target magnification.

    Sizes are rounded half to even; patch_l0 is cut, so it may differ from
    patch_src. Null where the magnification is unknown or below the target.
    """
    down = mag.cast("double") / target_mag
    level = optimal_level(ds, down)["level"]
    src = half_even(patch * down)
    read = F.greatest(F.lit(1), half_even(src / F.get(ds, level.cast("int"))))
    floor = F.floor(patch.cast("bigint") * mag / target_mag).cast("bigint")
    whole = F.struct(level.alias("level"), src.alias("patch_src"), half_even(step * down).alias("step_src"), floor.alias("patch_l0"), read.alias("read"))
    return F.when(geometry_error(mag, target_mag).isNull(), whole)


def thumbnail_size(w: Column, h: Column, ds: Column, mag: Column, power: Column) -> Column:
    """struct(level, read_w, read_h, out_w, out_h, interpolation) of a thumbnail at a magnification; null without one."""
    down = F.greatest(F.lit(1e-6), mag.cast("double") / power)
    level = optimal_level(ds, down)["level"]
    own = F.get(ds, level.cast("int"))
    at_least = lambda x: F.greatest(F.lit(1), half_even(x)).cast("bigint")
    read_w, read_h, out_w, out_h = at_least(w / own), at_least(h / own), at_least(w / down), at_least(h / down)
    how = F.when((out_w < read_w) | (out_h < read_h), F.lit("area")).otherwise(F.lit("cubic"))
    whole = F.struct(level.alias("level"), read_w.alias("read_w"), read_h.alias("read_h"), out_w.alias("out_w"), out_h.alias("out_h"), how.alias("interpolation"))
    return F.when(mag.isNotNull(), whole)


def overlap(patch: Column, step: Column) -> Column:
    return F.greatest(F.lit(0), patch - step)


def scale_points(points: Column, sx: Column, sy: Column) -> Column:
    """Points scaled in single precision and cut towards zero."""
    cut = lambda v, s: (v.cast("float") * s.cast("float")).cast("bigint")
    return F.transform(points, lambda p: F.struct(cut(p["x"], sx).alias("x"), cut(p["y"], sy).alias("y")))


def edges_of(points: Column) -> Column:
    """Closed polygon as an array of struct(ax, ay, bx, by)."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def area(points: Column) -> Column:
    """Area between pixel centres (half the absolute shoelace sum)."""
    twice = F.aggregate(edges_of(points), F.lit(0).cast("bigint"), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])
    return F.abs(twice).cast("double") / 2.0


def area_of(corners: list[tuple[Column, Column]]) -> Column:
    """``area`` of a polygon whose number of corners is known, without an array, so that its code is compiled."""
    twice = [a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1])]
    return F.abs(sum(twice[1:], twice[0])).cast("double") / 2.0


def bounds(points: Column) -> Column:
    """struct(x, y, w, h): least corner and sizes that count both ends."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x + 1).alias("w"), (F.array_max(ys) - y + 1).alias("h"))


def edges_at(edges: Column, y: Column) -> Column:
    """The edges a horizontal line meets: all that decide whether its points are inside."""
    return F.filter(edges, lambda e: (F.least(e["ay"], e["by"]) <= y) & (F.greatest(e["ay"], e["by"]) >= y))


def _on(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )


def _odd(edges: Column, x: Column, y: Column) -> Column:
    crossed = F.filter(
        edges,
        lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((x - e["ax"]).cast("double") < (e["bx"] - e["ax"]).cast("double") * (y - e["ay"]).cast("double") / (e["by"] - e["ay"]).cast("double")),
    )
    return F.size(crossed) % 2 == 1


def row_of(edges: Column, y: Column) -> Column:
    """struct(cuts, on) of a polygon and a row: all that decides about the row's points with whole coordinates.

    A point is inside if an odd number of ``cuts`` is above its x, and on an edge if a span of ``on`` holds it.
    """
    slope = lambda e: (e["bx"] - e["ax"]).cast("double") * (y - e["ay"]).cast("double") / (e["by"] - e["ay"]).cast("double")
    cuts = F.transform(F.filter(edges, lambda e: (e["ay"] > y) != (e["by"] > y)), lambda e: e["ax"] + F.ceil(slope(e)))

    def meets(e: Column) -> Column:
        whole = F.when(e["ay"] == e["by"], True).otherwise((e["bx"] - e["ax"]) * (y - e["ay"]) % F.when(e["ay"] != e["by"], e["by"] - e["ay"]) == 0)
        return (F.least(e["ay"], e["by"]) <= y) & (F.greatest(e["ay"], e["by"]) >= y) & whole

    def span(e: Column) -> Column:
        level = e["ay"] == e["by"]
        low = F.when(level, F.least(e["ax"], e["bx"])).otherwise(e["ax"] + slope(e).cast("bigint"))
        return F.struct(low.alias("low"), F.when(level, F.greatest(e["ax"], e["bx"])).otherwise(low).alias("high"))

    return F.struct(cuts.alias("cuts"), F.transform(F.filter(edges, meets), span).alias("on"))


def row_inside(row: Column, x: Column) -> Column:
    return F.size(F.filter(row["cuts"], lambda c: c > x)) % 2 == 1


def row_on(row: Column, x: Column) -> Column:
    return F.exists(row["on"], lambda s: (s["low"] <= x) & (s["high"] >= x))


def touches(edges: Column, x: Column, y: Column) -> Column:
    """Inside the polygon or on its edge."""
    return _on(edges, x, y) | _odd(edges, x, y)


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    return _odd(edges, x, y) & ~_on(edges, x, y)
