"""Pixel tests and resampling: integer column expressions, and numpy kernels with the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of pixels that makes a patch dark or blank, and the brightness a blank pixel has at least.
MIN_SHARE = 0.7
BRIGHT = 200


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in 14-bit fixed point (weights 0.299, 0.587, 0.114)."""
    return F.shiftright((r.cast("int") * 4899 + g.cast("int") * 9617 + b.cast("int") * 1868 + 8192), 14)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation 0..255, halves up, in integers; 0 for black."""
    top, low = F.greatest(r, g, b).cast("int"), F.least(r, g, b).cast("int")
    return F.when(top == 0, F.lit(0)).otherwise(F.floor((510 * (top - low) + top) / (2 * top))).cast("int")


def dark_share(r: Column, g: Column, b: Column, limit: int) -> Column:
    """Aggregate: share of pixels darker than ``limit``."""
    return F.avg((gray(r, g, b) < limit).cast("int"))


def blank_share(r: Column, g: Column, b: Column, limit: int) -> Column:
    """Aggregate: share of bright pixels with a saturation under ``limit``."""
    return F.avg(((saturation(r, g, b) < limit) & (F.greatest(r, g, b) >= BRIGHT)).cast("int"))


def is_black(pixels: np.ndarray, limit: int = 40, share: float = MIN_SHARE) -> bool:
    """The same test on an RGB array (h, w, 3) of bytes."""
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    luma = (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14
    return bool((luma < limit).mean() >= share) if luma.size else False


def is_white(pixels: np.ndarray, limit: int = 5, share: float = MIN_SHARE, bright: int = BRIGHT) -> bool:
    top, low = pixels.max(axis=-1).astype(np.int64), pixels.min(axis=-1).astype(np.int64)
    sat = np.where(top == 0, 0, (510 * (top - low) + top) // np.maximum(2 * top, 1))
    return bool(((sat < limit) & (top >= bright)).mean() >= share) if top.size else False


def _share_udf(test, limit: int) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([test(np.frombuffer(d, np.uint8).reshape(1, -1, 3), limit) for d in data], dtype=bool)

    return run


def dark_mask(data: Column, limit: int) -> Column:
    """Whether a patch (binary, RGB) is dark, in Arrow batches."""
    return _share_udf(is_black, limit)(data)


def blank_mask(data: Column, limit: int) -> Column:
    """Whether a patch (binary, RGB) is blank, in Arrow batches."""
    return _share_udf(is_white, limit)(data)


def nearest_index(i: Column, source: Column, target: Column) -> Column:
    """Source index of target index i in nearest-neighbour resampling."""
    return F.least(F.floor((i + F.lit(0.5)) * source / target), source - 1).cast("bigint")


def resize_nearest(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.minimum(((np.arange(height) + 0.5) * pixels.shape[0] / height).astype(int), pixels.shape[0] - 1)
    columns = np.minimum(((np.arange(width) + 0.5) * pixels.shape[1] / width).astype(int), pixels.shape[1] - 1)
    return pixels[rows][:, columns]


def _weights(source: int, target: int, area: bool) -> np.ndarray:
    """(target, source) resampling weights: box overlap when ``area``, else linear between centres."""
    out = np.zeros((target, source))
    scale = source / target
    if area:
        for i in range(target):
            lo, hi = i * scale, (i + 1) * scale
            cells = np.arange(int(lo), min(source, int(np.ceil(hi))))
            out[i, cells] = np.minimum(cells + 1, hi) - np.maximum(cells, lo)
        return out / out.sum(axis=1, keepdims=True)
    at = np.clip((np.arange(target) + 0.5) * scale - 0.5, 0, source - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, source - 1)
    out[np.arange(target), low] += 1 - (at - low)
    out[np.arange(target), high] += at - low
    return out


def _cubic(source: int, target: int) -> np.ndarray:
    out = np.zeros((target, source))
    at = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(at).astype(int)
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        a = -0.75
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        np.add.at(out, (np.arange(target), np.clip(base + k, 0, source - 1)), w)
    return out


def resample(pixels: np.ndarray, height: int, width: int, how: str = "linear") -> np.ndarray:
    """``pixels`` (h, w) or (h, w, c) at another size: area, cubic, nearest, or linear for any other name."""
    if pixels.shape[:2] == (height, width):
        return pixels
    if how == "nearest":
        return resize_nearest(pixels, height, width)
    make = {"area": lambda s, t: _weights(s, t, True), "cubic": _cubic}.get(how, lambda s, t: _weights(s, t, False))
    rows, columns = make(pixels.shape[0], height), make(pixels.shape[1], width)
    out = np.tensordot(rows, pixels.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(columns, out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if pixels.dtype == np.uint8 else out.astype(pixels.dtype)


def as_bytes(image: np.ndarray) -> np.ndarray:
    """Any image array as bytes (h, w, 3): channels-first is turned, gray is tripled, floats up to 1 are scaled."""
    x = np.asarray(image)
    if x.ndim == 3 and x.shape[0] in (1, 3, 4) and x.shape[2] not in (1, 3, 4):
        x = np.moveaxis(x, 0, 2)
    if x.ndim == 2:
        x = x[..., None]
    x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[..., :3]
    if x.dtype != np.uint8:
        x = x * 255 if x.size and np.issubdtype(x.dtype, np.floating) and x.max() <= 1 else x
        x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(x)
