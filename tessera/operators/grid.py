"""Patch grids over tissue contours, with ordinals and passports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import bounds, edges_of, row_inside, row_of, row_on

PASSPORT_CHARS = 160


def patch_grid(contours: DataFrame, step: str = "step_src") -> DataFrame:
    """One row for each grid point of each contour (columns points and ``step``): adds x, y.

    The grid is anchored at the contour's own bounding box and may run over the
    slide's edges; grids of different contours may hold the same point.
    """
    boxed = contours.withColumn("_box", bounds(F.col("points"))).where((F.size("points") > 0) & (F.col(step) > 0))
    rows = boxed.withColumn("y", F.explode(F.sequence(F.col("_box.y"), F.col("_box.y") + F.col("_box.h") - 1, F.col(step))))
    return rows.withColumn("x", F.explode(F.sequence(F.col("_box.x"), F.col("_box.x") + F.col("_box.w") - 1, F.col(step)))).drop("_box")


def tissue_grid(contours: DataFrame, step: str = "step_src", patch: str = "patch_src") -> DataFrame:
    """The grid points whose patch is in tissue: columns of ``contours`` without polygons, and x, y.

    ``contours`` has points and holes (an array of polygons). A patch counts if
    its centre is not strictly inside a hole and one of four probes, a quarter
    of the patch off the centre on both axes, is in the contour or on its edge.
    Where a probe's row crosses and touches the edges is the same for all points of
    the row, so that is found before the row is spread out; a point is only compared with these places.
    """
    half = F.floor(F.col(patch) / 2).cast("bigint")
    quarter = F.floor(half * F.lit(0.5)).cast("bigint")
    polygons = F.coalesce("holes", F.array().cast("array<array<struct<x:bigint,y:bigint>>>"))
    found = {"_box": bounds(F.col("points")), "_edges": edges_of(F.col("points")), "_gaps": F.transform(polygons, edges_of), "_half": half, "_q": quarter}
    base = _once(contours.where((F.size("points") > 0) & (F.col(step) > 0)), found, ["points", "holes"])
    rows = base.withColumn("y", F.explode(F.sequence(F.col("_box.y"), F.col("_box.y") + F.col("_box.h") - 1, F.col(step))))
    cy = F.col("y") + F.col("_half")
    gaps = F.filter(F.transform("_gaps", lambda h: row_of(h, cy)), lambda r: F.size(r["cuts"]) > 0)
    rows = _once(rows, {"_above": row_of(F.col("_edges"), cy - F.col("_q")), "_below": row_of(F.col("_edges"), cy + F.col("_q")), "_holes": gaps}, ["_edges", "_gaps"])
    rows = rows.where(" or ".join(f"size({r}.{part}) > 0" for r in ("_above", "_below") for part in ("cuts", "on")))
    spread = rows.withColumn("x", F.explode(F.sequence(F.col("_box.x"), F.col("_box.x") + F.col("_box.w") - 1, F.col(step))))
    centre = F.col("x") + F.col("_half")
    probes = [test(F.col(r), centre + sign * F.col("_q")) for test in (row_inside, row_on) for r in ("_above", "_below") for sign in (-1, 1)]
    in_hole = F.exists("_holes", lambda h: row_inside(h, centre) & ~row_on(h, centre))
    kept = spread.where(reduce(Column.__or__, probes)).where(~in_hole)
    return kept.drop("_box", "_half", "_q", "_above", "_below", "_holes")


def _once(rows: DataFrame, found: dict[str, Column], gone: list[str]) -> DataFrame:
    """``rows`` with the columns ``found`` and without ``gone``. The new ones are the only row of a generator, behind which filters and later columns do not compute them again."""
    kept = [c for c in rows.columns if c not in gone]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in found.items()]))))


def with_ordinals(patches: DataFrame, slide: str = "slide_id") -> DataFrame:
    """Adds patch_idx (0-based: contour, then y, then x) and the slide's total."""
    order = Window.partitionBy(slide).orderBy("contour_idx", "y", "x")
    return patches.withColumns({"patch_idx": (F.row_number().over(order) - 1).cast("bigint"), "total": F.count("*").over(Window.partitionBy(slide))})


def passport(stem: Column, x: Column, y: Column, rw: Column, rh: Column, level: Column, mag: Column, target_mag: Column, total: Column) -> Column:
    """Patch label, cut at PASSPORT_CHARS; unknown or zero magnifications are "na"."""
    known = lambda m: F.coalesce(F.when(m != 0, m.cast("string")), F.lit("na"))
    parts = [stem, F.lit("__x"), x.cast("string"), F.lit("_y"), y.cast("string"), F.lit("_rw"), rw.cast("string"), F.lit("_rh"), rh.cast("string"), F.lit("_lv"), level.cast("string")]
    parts += [F.lit("_mag"), known(mag), F.lit("_tmag"), known(target_mag), F.lit("_total"), total.cast("string")]
    return F.substring(F.concat(*parts), 1, PASSPORT_CHARS)


def duplicates(patches: DataFrame, slide: str = "slide_id") -> DataFrame:
    """Points that more than one contour of a slide gave: slide, x, y, n."""
    return patches.groupBy(slide, "x", "y").agg(F.count("*").alias("n")).where("n > 1")
