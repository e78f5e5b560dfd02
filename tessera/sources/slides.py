"""Slides as rows: discovery, backends, standard images, and a data source for pyramidal files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.metadata import extract_mag, extract_mpp, mpp_error
from tessera.functions.paths import SUFFIXES, backend_of, is_supported, stem_of
from tessera.functions.pixels import as_bytes, resample

#: Columns that every backend gives for a slide.
SLIDE_SCHEMA = "path string, w bigint, h bigint, ds array<double>, dims array<struct<w:bigint,h:bigint>>, meta map<string,string>, error string"


def discover(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(slide_id, path, stem, backend, length) of the supported files below ``path``, sorted by path.

    Listing only: the content column is pruned, so no file is read. A path to
    one file is taken whatever its suffix. No supported file is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    single = files.where(F.col("path").endswith(path.rstrip("/").rsplit("/", 1)[-1])) if "." in path.rsplit("/", 1)[-1] else files.limit(0)
    found = files.where(is_supported(F.col("path"))).unionByName(single).distinct()
    out = found.select(F.xxhash64("path").alias("slide_id"), "path", stem_of(F.col("path")).alias("stem"), backend_of(F.col("path")).alias("backend"), "length")
    if out.isEmpty():
        raise ValueError(f"no supported slide below {path}")
    return out.orderBy("path")


def stem_collisions(slides: DataFrame) -> DataFrame:
    """(stem, n) of stems that more than one slide has: they would share resolution overrides."""
    return slides.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


class Backends:
    """Readers by name, and which suffix goes to which."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable] = {}
        self._suffixes = dict(SUFFIXES)

    def register(self, name: str, reader: Callable) -> None:
        self._readers[name] = reader

    def map_suffix(self, suffix: str, backend: str) -> None:
        if backend not in self._readers:
            raise ValueError(f"unknown backend {backend}")
        self._suffixes[suffix.lower().removeprefix(".")] = backend

    def detect(self, path: str) -> str | None:
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        return self._suffixes.get(name.rsplit(".", 1)[-1].lower()) if "." in name[1:] else None

    def load(self, path: str, backend: str | None = None, **options):
        name = backend or self.detect(path)
        if name is None:
            raise ValueError(f"no backend reads {path}")
        if name not in self._readers:
            raise ValueError(f"unknown backend {name}")
        return self._readers[name](path, **options)

    def try_load(self, path: str, backends: Sequence[str] | None = None, **options):
        """The first of ``backends`` that opens ``path``; if none does, one error with all reasons."""
        reasons = []
        for name in backends or sorted(self._readers):
            try:
                return self.load(path, name, **options)
            except Exception as e:  # noqa: BLE001
                reasons.append(f"{name}: {e}")
        raise ValueError(f"no backend opens {path}: " + "; ".join(reasons))


def image_slides(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Standard images as slides of one level: SLIDE_SCHEMA with slide_id, stem and ``data`` (rows of BGR bytes).

    What the JVM cannot decode has an error instead of sizes. ``data`` is
    pruned wherever only metadata is used.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower()).load(path).select("image.*")
    # The image reader writes local paths with an empty host, the file listing without one.
    images = images.withColumn("origin", F.regexp_replace("origin", "^file:///", "file:/"))
    rows = images.select(F.xxhash64("origin").alias("slide_id"), F.col("origin").alias("path"), stem_of(F.col("origin")).alias("stem"), F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"), "nChannels", "data")
    good = F.col("w") > 0
    return rows.select(
        "slide_id", "path", "stem", F.when(good, F.col("w")).alias("w"), F.when(good, F.col("h")).alias("h"),
        F.array(F.lit(1.0)).alias("ds"), F.array(F.struct("w", "h")).alias("dims"),
        F.create_map(F.lit("format"), F.lit("unknown"), F.lit("mode"), F.lit("RGB")).alias("meta"),
        F.when(~good, F.lit("not an image")).alias("error"), F.col("nChannels").alias("channels"), "data",
    )


def with_resolution(slides: DataFrame, mpp: str = "mpp") -> DataFrame:
    """Adds mag and completes mpp, which is an override or null; the reason why there is none joins ``error``.

    Pyramidal files tell their resolution and objective in ``meta``; standard images carry none of their own.
    """
    own = F.coalesce(F.col(mpp), extract_mpp(F.col("meta")))
    found = slides.withColumn(mpp, own)
    return found.withColumns({"mag": extract_mag(F.col("meta"), F.col(mpp)), "error": F.coalesce("error", F.concat(F.lit("resolution "), mpp_error(F.col(mpp))))})


def level_size(dims: Column, level: Column | int) -> Column:
    """(w, h) of a level, null outside the pyramid."""
    return F.get(dims, level if isinstance(level, Column) else F.lit(level))


def pixels_of(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    """RGB bytes (h, w, 3) of an image row's data."""
    x = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    return as_bytes(x if channels < 3 else x[..., 2::-1])


def crop(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """Region at (x, y); what lies outside the image is black."""
    out = np.zeros((h, w, 3), np.uint8)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, pixels.shape[1]), min(y + h, pixels.shape[0])
    if x0 < x1 and y0 < y1:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = pixels[y0:y1, x0:x1]
    return out


class Pixels:
    """The pixels of one slide on an executor: regions at a level, and the whole at another size."""

    def region(self, x: int, y: int, level: int, w: int, h: int) -> np.ndarray:
        """RGB bytes (h, w, 3) of a region that begins at (x, y) of level 0; ``w`` and ``h`` are pixels of ``level``."""
        raise NotImplementedError

    def thumbnail(self, level: int, w: int, h: int, out_w: int, out_h: int, how: str) -> np.ndarray:
        """``level``, which is (w, h), at another size."""
        return resample(self.region(0, 0, level, w, h), out_h, out_w, how)

    def close(self) -> None:
        pass


class ImagePixels(Pixels):
    """A decoded standard image: one level."""

    def __init__(self, pixels: np.ndarray) -> None:
        self.pixels = pixels

    def region(self, x: int, y: int, level: int, w: int, h: int) -> np.ndarray:
        if level:
            raise ValueError(f"a standard image has no level {level}")
        return crop(self.pixels, x, y, w, h)


class PyramidPixels(Pixels):
    """A pyramidal file, of which only the regions asked for are decoded. Needs the openslide package where it is opened."""

    #: Pixels that one read returns at most; a larger thumbnail is put together in bands.
    BAND = 1 << 24

    def __init__(self, path: str) -> None:
        import openslide

        self.slide = openslide.OpenSlide(local_path(path))

    def region(self, x: int, y: int, level: int, w: int, h: int) -> np.ndarray:
        rows = max(1, self.BAND // max(1, w))
        down = self.slide.level_downsamples[level]
        parts = [np.asarray(self.slide.read_region((x, y + round(top * down)), level, (w, min(rows, h - top)))) for top in range(0, h, rows)]
        return flatten(np.concatenate(parts))

    def close(self) -> None:
        self.slide.close()


def flatten(pixels: np.ndarray) -> np.ndarray:
    """RGB bytes of RGBA ones; what lies outside a slide is transparent and comes out black."""
    return np.ascontiguousarray(pixels[..., :3] * (pixels[..., 3:] > 0)).astype(np.uint8) if pixels.shape[-1] == 4 else pixels


def local_path(path: str) -> str:
    """The path under which executors open a file that is on a file system they mount."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"pyramidal files are opened by path; {path} is not on a mounted file system")
    return path


def open_pixels(path: str, data: bytes | None, w: int, h: int, channels: int | None) -> Pixels:
    """Pixels of a slide row: those of ``data`` if the row carries any, else those of its file."""
    return PyramidPixels(path) if data is None else ImagePixels(pixels_of(data, int(h), int(w), int(channels)))


def pyramid_slides(listed: DataFrame) -> DataFrame:
    """Pyramidal files of a listing (path) as slides, with the columns of ``image_slides`` and no ``data``: metadata read in tasks, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [describe(p) for p in batch["path"]]
            yield pd.DataFrame(rows, columns=["path", "w", "h", "ds", "dims", "meta", "error"]).astype({"w": "Int64", "h": "Int64"})

    found = listed.select("path").repartition("path").mapInPandas(run, SLIDE_SCHEMA)
    return found.select(
        F.xxhash64("path").alias("slide_id"), "path", stem_of(F.col("path")).alias("stem"), "w", "h", "ds", "dims", "meta", "error",
        F.lit(None).cast("int").alias("channels"), F.lit(None).cast("binary").alias("data"),
    )


def region_reads(slides: DataFrame, regions: DataFrame) -> DataFrame:
    """(slide_id, region_id, w, h, data): RGB bytes of each of ``regions`` (slide_id, region_id, x, y, level, w, h).

    x and y are at level 0; what lies outside a slide is black. A level that a slide lacks fails its read.
    """
    wanted = regions.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "x", "y", "level", "w", "h"))).alias("regions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slide, path, w, h, channels, data, found in batch.itertuples(index=False):
                pixels = open_pixels(path, data, w, h, channels)
                try:
                    for r in found:
                        cut = pixels.region(r["x"], r["y"], r["level"], r["w"], r["h"])
                        yield pd.DataFrame({"slide_id": [slide], "region_id": [r["region_id"]], "w": [r["w"]], "h": [r["h"]], "data": [cut.tobytes()]})
                finally:
                    pixels.close()

    rows = slides.where("error is null").select("slide_id", "path", "w", "h", "channels", "data").join(wanted, "slide_id")
    return rows.mapInPandas(run, "slide_id bigint, region_id bigint, w bigint, h bigint, data binary")


def patch_pixels(slides: DataFrame, patches: DataFrame, size: int, chunk: int = 256) -> DataFrame:
    """(slide_id, patch_idx, data): RGB bytes of every patch, scaled to ``size`` where it was read at another one.

    A slide's coordinates travel to its pixels, not the pixels to each
    coordinate; patches leave in chunks, so a task holds one image, or one open pyramid, and one chunk.
    """
    coords = patches.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("patch_idx", "x", "y", "read", "level"))).alias("coords"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slide, path, w, h, channels, data, found in batch.itertuples(index=False):
                pixels = open_pixels(path, data, w, h, channels)
                try:
                    for i in range(0, len(found), chunk):
                        part = found[i : i + chunk]
                        cut = [resample(pixels.region(c["x"], c["y"], c["level"], c["read"], c["read"]), size, size).tobytes() for c in part]
                        yield pd.DataFrame({"slide_id": slide, "patch_idx": [c["patch_idx"] for c in part], "data": cut})
                finally:
                    pixels.close()

    rows = slides.where("error is null").select("slide_id", "path", "w", "h", "channels", "data").join(coords, "slide_id")
    return rows.mapInPandas(run, "slide_id bigint, patch_idx bigint, data binary")


def describe(path: str) -> tuple:
    """A row of SLIDE_SCHEMA for a pyramidal file; where it does not open, an error instead of sizes."""
    try:
        import openslide
    except ImportError as e:
        return path, None, None, None, None, None, f"openslide is not installed: {e}"
    try:
        with openslide.OpenSlide(local_path(path)) as s:
            dims = [{"w": int(w), "h": int(h)} for w, h in s.level_dimensions]
            return path, dims[0]["w"], dims[0]["h"], [float(d) for d in s.level_downsamples], dims, dict(s.properties), None
    except Exception as e:  # noqa: BLE001
        return path, None, None, None, None, None, f"{type(e).__name__}: {e}"


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _PyramidReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield describe(partition.path)


class PyramidSource(DataSource):
    """``spark.read.format("pyramid").option("paths", ...)``: metadata of pyramidal files, a partition for each.

    Needs the openslide package on the executors; without it, and for files
    that do not open, the row has an error instead of sizes.
    """

    @classmethod
    def name(cls) -> str:
        return "pyramid"

    def schema(self) -> str:
        return SLIDE_SCHEMA

    def reader(self, schema) -> _PyramidReader:
        return _PyramidReader([p for p in self.options.get("paths", "").split("\n") if p])
