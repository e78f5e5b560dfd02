"""From tissue masks to contours with holes."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area

#: Smallest hole in mask pixels, and how many of a slide's largest holes count.
MIN_HOLE = 16.0
MAX_HOLES = 10
POINTS = "array<struct<x:bigint,y:bigint>>"
CONTOUR_SCHEMA = f"slide_id bigint, contour_idx bigint, kind string, parent_idx bigint, points {POINTS}"


def tissue_filter(contours: DataFrame, threshold: float, mask_pixels: str | int) -> DataFrame:
    """Outer contours (column points) of at least ``threshold`` of the mask's pixels; adds area."""
    limit = F.lit(threshold) * (F.col(mask_pixels) if isinstance(mask_pixels, str) else F.lit(mask_pixels))
    return contours.withColumn("area", area(F.col("points"))).where(F.col("area") >= limit)


def top_holes(holes: DataFrame, min_area: float = MIN_HOLE, most: int = MAX_HOLES, slide: str = "slide_id") -> DataFrame:
    """A slide's largest holes (columns area, hole_idx), earlier ones first among equals.

    The quota is the slide's, not a contour's, and is taken before contours are
    filtered: holes of contours that go use it up too.
    """
    rank = F.row_number().over(Window.partitionBy(slide).orderBy(F.desc("area"), "hole_idx"))
    return holes.where(F.col("area") >= min_area).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def attach_holes(contours: DataFrame, holes: DataFrame, slide: str = "slide_id") -> DataFrame:
    """``contours`` with ``holes``: the polygons of its holes (hole_idx, parent_idx, points), by discovery order."""
    listed = holes.groupBy(F.col(slide), F.col("parent_idx").alias("contour_idx")).agg(F.array_sort(F.collect_list(F.struct("hole_idx", "points"))).alias("found"))
    out = contours.join(listed, [slide, "contour_idx"], "left")
    return out.withColumn("holes", F.coalesce(F.transform("found", lambda h: h["points"]), F.array().cast(f"array<{POINTS}>"))).drop("found")


class Regions:
    """Connected regions of a mask as runs of pixels: ``row``, ``start``, ``end`` (exclusive) and ``number`` of each run, in raster order.

    Regions are numbered from 0 by their first pixel in raster order. ``boxes`` has (top, left, bottom, right) of each,
    the last two exclusive, and ``first`` the run that it begins with.
    """

    def __init__(self, mask: np.ndarray, eight: bool) -> None:
        self.shape = mask.shape
        edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        self.row, self.start = np.nonzero(edges == 1)
        self.end = np.nonzero(edges == -1)[1]
        root = self._roots(int(eight))
        self.first, self.number = np.unique(root, return_inverse=True)
        n = len(self.first)
        self.boxes = np.zeros((n, 4), np.int64)
        self.boxes[:, :2] = max(mask.shape, default=0)
        for k, (ufunc, value) in enumerate(((np.minimum, self.row), (np.minimum, self.start), (np.maximum, self.row + 1), (np.maximum, self.end))):
            ufunc.at(self.boxes[:, k], self.number, value)

    def _roots(self, reach: int) -> np.ndarray:
        """The first run of each run's region. Runs of neighbouring rows touch if they overlap, or with ``reach`` 1 at a corner."""
        wide = self.shape[1] + 2
        starts, ends = self.row * wide + self.start, self.row * wide + self.end
        low = np.searchsorted(ends, starts + wide - reach, "right")
        many = np.maximum(np.searchsorted(starts, ends + wide + reach, "left") - low, 0)
        above = np.repeat(np.arange(len(starts)), many)
        below = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(above))
        root = np.arange(len(starts))
        while True:
            u, v = root[above], root[below]
            if (u == v).all():
                return root
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]

    def __len__(self) -> int:
        return len(self.first)

    def labels(self) -> np.ndarray:
        """Numbers from 1 as an image, 0 outside."""
        out = np.zeros(self.shape, np.int32)
        long = self.end - self.start
        at = np.repeat(self.row * self.shape[1] + self.start - np.cumsum(long) + long, long) + np.arange(int(long.sum()))
        out.reshape(-1)[at] = np.repeat(self.number + 1, long)
        return out


_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def _trace(inside: np.ndarray, start: tuple[int, int], first: int, corner: tuple[int, int]) -> list[tuple[int, int]]:
    """Border pixels (x, y) of an 8-connected region, walked around from ``start`` with Moore's rule; ``inside`` lies at ``corner`` (y, x)."""
    wide = inside.shape[1] + 2
    flat = np.pad(inside, 1).tobytes()
    steps = [y * wide + x for y, x in _AROUND]
    at, back, begin = (start[0] - corner[0] + 1) * wide + start[1] - corner[1] + 1, first, None
    walked: list[int] = []
    while True:
        for turn in range(1, 9):
            direction = (back + turn) % 8
            if flat[at + steps[direction]]:
                break
        else:
            return [(start[1], start[0])]
        if begin is None:
            begin = (at, direction)
        elif (at, direction) == begin:
            return [(p % wide - 1 + corner[1], p // wide - 1 + corner[0]) for p in walked]
        walked.append(at)
        at, back = at + steps[direction], (direction + 4) % 8


def mask_to_contours(mask: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[tuple[int, list[tuple[int, int]]]]]:
    """(outer contours, holes with their parent's number) of a boolean mask.

    Foreground is 8-connected, background 4-connected. Contours go by their
    topmost, then leftmost pixel and list every border pixel; a hole's contour
    runs through the foreground pixels around it. Regions are found in runs of pixels at once, and each
    is traced in its own bounding box.
    """
    mask = np.asarray(mask, bool)
    found = Regions(mask, True)
    regions = found.labels()
    outer = []
    for k, (top, left, bottom, right) in enumerate(found.boxes.tolist()):
        run = found.first[k]
        outer.append(_trace(regions[top:bottom, left:right] == k + 1, (int(found.row[run]), int(found.start[run])), 4, (top, left)))
    # One more pixel of background on each side joins all that is open to the edge; it is region 0.
    gaps = Regions(np.pad(~mask, 1, constant_values=True), False)
    spots = gaps.labels()
    holes = []
    for k, (top, left, bottom, right) in enumerate(gaps.boxes.tolist()):
        if k == 0:
            continue
        run = gaps.first[k]
        y, x = int(gaps.row[run]) - 1, int(gaps.start[run]) - 1
        # The pixel left of a hole's first one is foreground and lies on the hole's border.
        parent = int(regions[y, x - 1])
        filled = spots[top - 1 : bottom + 1, left - 1 : right + 1] == k + 1
        near = np.zeros_like(filled)
        near[1:] |= filled[:-1]
        near[:-1] |= filled[1:]
        near[:, 1:] |= filled[:, :-1]
        near[:, :-1] |= filled[:, 1:]
        # A hole never touches the edge, so its box with one pixel around lies in the mask.
        corner = (top - 2, left - 2)
        border = near & (regions[corner[0] : corner[0] + filled.shape[0], corner[1] : corner[1] + filled.shape[1]] == parent)
        holes.append((parent - 1, _trace(border, (y, x - 1), 0, corner)))
    return outer, holes


def contours_of_masks(masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Contours of every mask (slide_id, h, w, data: row-major array<float>): outer ones and holes as rows.

    A mask is one row and bounded (a thumbnail of 1024 by 1024 at most), so
    each is traced by itself in an Arrow batch; nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for slide, h, w, data in zip(batch["slide_id"], batch["h"], batch["w"], batch["data"]):
                grid = np.asarray(data, np.float32).reshape(int(h), int(w)) > threshold
                outer, holes = mask_to_contours(grid)
                rows += [(slide, i, "tissue", None, [{"x": x, "y": y} for x, y in c]) for i, c in enumerate(outer)]
                rows += [(slide, i, "hole", parent, [{"x": x, "y": y} for x, y in c]) for i, (parent, c) in enumerate(holes)]
            out = pd.DataFrame(rows, columns=["slide_id", "contour_idx", "kind", "parent_idx", "points"])
            out["parent_idx"] = out["parent_idx"].astype("Int64")
            yield out

    return masks.select("slide_id", "h", "w", "data").mapInPandas(run, CONTOUR_SCHEMA)
