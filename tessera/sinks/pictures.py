"""PNG files: patches, and overlays of masks, contours and grids on thumbnails."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.pixels import resample

GREEN, RED, BLUE = (0, 255, 0), (255, 0, 0), (0, 0, 255)
ALPHA = 80


def png(pixels: np.ndarray) -> bytes:
    """An RGB (h, w, 3) or gray (h, w) array of bytes as a PNG file."""
    x = np.ascontiguousarray(pixels, np.uint8)
    h, w = x.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if x.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its scheme (file, hdfs, s3, gs and so on), and the folder's path there."""
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows below ``folder``, which all executors share; the number of files.

    Each file appears under its name only when it is whole, so a task that runs
    twice does no harm: it is renamed into place, or put at once where the store has no renaming.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        store, base = store_of(folder)
        renames = store.type_name in ("local", "hdfs", "subtree")
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                target = f"{base.rstrip('/')}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.tmp" if renames else target
                with store.open_output_stream(part) as f:
                    f.write(content)
                if renames:
                    store.move(part, target)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def patch_files(pixels: DataFrame, patches: DataFrame, size: int) -> DataFrame:
    """(name, content): a PNG for each patch, <stem>/<stem>_x<x>_y<y>.png."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "content": [png(np.frombuffer(d, np.uint8).reshape(size, size, 3)) for d in batch["data"]]})

    name = F.concat("slide_stem", F.lit("/"), "slide_stem", F.lit("_x"), F.col("x").cast("string"), F.lit("_y"), F.col("y").cast("string"), F.lit(".png"))
    named = patches.select("slide_id", "patch_idx", name.alias("name")).join(pixels, ["slide_id", "patch_idx"])
    return named.select("name", "data").mapInPandas(run, "name string, content binary")


def draw_line(image: np.ndarray, a: tuple[int, int], b: tuple[int, int], colour: tuple[int, int, int], width: int = 1) -> None:
    steps = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    xs, ys = (np.rint(np.linspace(a[i], b[i], steps + 1)).astype(int) for i in (0, 1))
    for dx in range(width):
        for dy in range(width):
            x, y = xs + dx, ys + dy
            inside = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
            image[y[inside], x[inside]] = colour


def draw_polygon(image: np.ndarray, points: Sequence[tuple[int, int]], colour: tuple[int, int, int], width: int) -> None:
    for a, b in zip(points, [*points[1:], points[0]] if points else []):
        draw_line(image, a, b, colour, width)


def mask_picture(thumbnail: np.ndarray, mask: np.ndarray, threshold: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(black and white mask, thumbnail with tissue tinted green), both of the thumbnail's size."""
    tissue = resample((mask > threshold).astype(np.uint8) * 255, *thumbnail.shape[:2], "nearest")
    tinted = thumbnail.copy()
    on = tissue > 0
    tinted[on] = ((255 - ALPHA) * thumbnail[on].astype(np.uint16) + ALPHA * np.array(GREEN, np.uint16)) // 255
    return tissue, tinted


def contour_picture(thumbnail: np.ndarray, tissue: Sequence, holes: Sequence, scale: tuple[float, float]) -> np.ndarray:
    """Thumbnail with tissue contours in red, two pixels wide, and holes in blue, one pixel wide."""
    out = thumbnail.copy()
    for group, colour, width in ((tissue, RED, 2), (holes, BLUE, 1)):
        for points in group:
            draw_polygon(out, [(int(x * scale[0]), int(y * scale[1])) for x, y in points], colour, width)
    return out


def grid_picture(thumbnail: np.ndarray, boxes: Sequence[tuple[int, int, int, int]], colour: tuple[int, int, int] = RED) -> np.ndarray:
    """Thumbnail with the patch boxes (x0, y0, x1, y1)."""
    out = thumbnail.copy()
    for x0, y0, x1, y1 in boxes:
        draw_polygon(out, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], colour, 1)
    return out


def overlays(masks: DataFrame, contours: DataFrame | None, boxes: DataFrame | None, stems: DataFrame, masks_too: bool = True) -> DataFrame:
    """(name, content) of a slide's overlays; those whose table is None are left out, those of the mask without ``masks_too``.

    ``masks`` has the thumbnail and mask, ``contours`` (slide_id, kind, points
    in mask pixels), ``boxes`` (slide_id, x0, y0, x1, y1 in thumbnail pixels).
    """
    rows = masks.where("error is null").join(stems.select("slide_id", "stem"), "slide_id")
    none = F.lit(None)
    listed = {"tissue": none, "holes": none, "boxes": none}
    if contours is not None:
        own = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.transform("points", lambda p: F.array(p["x"], p["y"]))))
        rows = rows.join(contours.groupBy("slide_id").agg(own("tissue").alias("_t"), own("hole").alias("_h")), "slide_id", "left")
        listed |= {"tissue": F.col("_t"), "holes": F.col("_h")}
    if boxes is not None:
        rows = rows.join(boxes.groupBy("slide_id").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("_b")), "slide_id", "left")
        listed["boxes"] = F.col("_b")
    kinds = {"tissue": "array<array<array<bigint>>>", "holes": "array<array<array<bigint>>>", "boxes": "array<array<bigint>>"}
    rows = rows.select("stem", "h", "w", "data", "thumbnail", *[c.cast(kinds[k]).alias(k) for k, c in listed.items()])
    with_contours, with_boxes = contours is not None, boxes is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.thumbnail, np.uint8).reshape(int(r.h), int(r.w), 3)
                pictures = dict(zip(("_mask_bw", "_mask"), mask_picture(image, np.asarray(r.data, np.float32).reshape(int(r.h), int(r.w))))) if masks_too else {}
                if with_contours:
                    pictures["_contours"] = contour_picture(image, [] if r.tissue is None else r.tissue, [] if r.holes is None else r.holes, (1.0, 1.0))
                if with_boxes:
                    pictures["_grid"] = grid_picture(image, [] if r.boxes is None else [tuple(int(v) for v in b) for b in r.boxes])
                out += [(f"{r.stem}{kind}.png", png(x)) for kind, x in pictures.items()]
            yield pd.DataFrame(out, columns=["name", "content"])

    return rows.mapInPandas(run, "name string, content binary")
