"""Tissue segmentation as a pluggable operator over slide images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Segmentation
from tessera.functions.geometry import thumbnail_size
from tessera.functions.pixels import resample
from tessera.sources.slides import open_pixels

#: A list of thumbnails (h, w, 3 bytes) to as many masks (h, w) of values from 0 to 1.
Segmenter = Callable[[list[np.ndarray]], list[np.ndarray]]
MASK_SCHEMA = "slide_id bigint, h bigint, w bigint, data array<float>, thumbnail binary, error string"


def saturation_segmenter(limit: int = 20, dark: int = 30) -> Segmenter:
    """Tissue is what has colour and is not black. A stand-in without a model: it is not equivalent to a trained one."""

    def run(images: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for x in images:
            top, low = x.max(axis=-1).astype(np.int64), x.min(axis=-1).astype(np.int64)
            sat = np.where(top == 0, 0, 255 * (top - low) // np.maximum(top, 1))
            out.append(((sat >= limit) & (top >= dark)).astype(np.float32))
        return out

    return run


def model_segmenter(checkpoint: str) -> Segmenter:
    """A promptable segmentation model from a checkpoint; its package is not part of this library."""
    try:
        import sam2  # noqa: F401
    except ImportError as e:
        raise RuntimeError(f"segmentation with {checkpoint} needs the sam2 package, which is not installed") from e
    raise RuntimeError("pass a segmenter that wraps the loaded model")


def shrink(h: int, w: int, most: int) -> tuple[int, int]:
    """Sizes of an image whose longer side is ``most`` at the most, shape kept."""
    scale = min(1.0, most / max(h, w))
    return max(1, round(h * scale)), max(1, round(w * scale))


def segment(images: DataFrame, segmenter: Segmenter, config: Segmentation) -> DataFrame:
    """MASK_SCHEMA of every slide with pixels and mag: its mask, the thumbnail it was made of, or an error.

    Thumbnails are made at ``thumbnail_power`` and shrunk to ``thumbnail_max``,
    ``batch_size`` of them go to the segmenter at once. A batch that fails is
    tried slide by slide, so one bad slide costs no other. Nothing is shuffled.
    """
    size, most = config.batch_size, config.thumbnail_max
    plan = thumbnail_size(F.col("w"), F.col("h"), F.col("ds"), F.col("mag"), F.lit(float(config.thumbnail_power)))
    rows = images.where("error is null").select("slide_id", "path", "w", "h", "channels", "data", plan.alias("t")).select("slide_id", "path", "w", "h", "channels", "data", "t.level", "t.read_w", "t.read_h", "t.out_w", "t.out_h", "t.interpolation")

    def one(slide: int, image: np.ndarray | None, mask: np.ndarray | None, error: str | None) -> tuple:
        if mask is None:
            return slide, None, None, None, None, error
        return slide, mask.shape[0], mask.shape[1], mask.astype(np.float32).ravel(), image.tobytes(), None

    def flush(held: list[tuple[int, np.ndarray]]) -> list[tuple]:
        try:
            return [one(s, x, m, None) for (s, x), m in zip(held, segmenter([x for _, x in held]), strict=True)]
        except Exception:  # noqa: BLE001
            out = []
            for s, x in held:
                try:
                    out.append(one(s, x, segmenter([x])[0], None))
                except Exception as e:  # noqa: BLE001
                    out.append(one(s, None, None, f"segmentation: {type(e).__name__}: {e}"))
            return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["slide_id", "h", "w", "data", "thumbnail", "error"]
        for batch in batches:
            held, out = [], []
            for slide, path, w, h, channels, data, level, read_w, read_h, out_w, out_h, how in batch.itertuples(index=False):
                if out_w is None or out_w != out_w:
                    out.append(one(slide, None, None, "segmentation: magnification unknown"))
                    continue
                try:
                    pixels = open_pixels(path, data, w, h, channels)
                    try:
                        image = pixels.thumbnail(int(level), int(read_w), int(read_h), int(out_w), int(out_h), how)
                    finally:
                        pixels.close()
                except Exception as e:  # noqa: BLE001
                    out.append(one(slide, None, None, f"thumbnail: {type(e).__name__}: {e}"))
                    continue
                held.append((slide, resample(image, *shrink(*image.shape[:2], most), "area")))
                if len(held) == size:
                    out += flush(held)
                    held = []
            out += flush(held) if held else []
            frame = pd.DataFrame(out, columns=columns)
            frame[["h", "w"]] = frame[["h", "w"]].astype("Int64")
            yield frame

    return rows.mapInPandas(run, MASK_SCHEMA)
