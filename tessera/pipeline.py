"""The three runs of the library: tissue masks, patch coordinates, and features, each resumable."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Extraction, Features, Output, Segmentation
from tessera.functions import geometry as geo
from tessera.functions.metadata import metadata_attrs
from tessera.functions.pixels import blank_mask, dark_mask
from tessera.operators import contours as ct
from tessera.operators import grid as gr
from tessera.operators.embed import embed
from tessera.operators.resume import complete_encoders, missing_features, pending
from tessera.operators.segment import Segmenter, saturation_segmenter, segment
from tessera.plans.catalog import Registry, default_registry
from tessera.session import ship
from tessera.sinks import pictures, tables
from tessera.sources.mpp_csv import read_mpp_csv
from tessera.sources.slides import discover, image_slides, patch_pixels, pyramid_slides, with_resolution

_POLYGON = "array<struct<x:bigint,y:bigint>>"


@dataclass
class Report:
    """Counts of a run."""

    slides: int = 0
    skipped: int = 0
    patches: int = 0
    failures: int = 0
    features: dict[str, int] = field(default_factory=dict)

    def lines(self) -> list[str]:
        out = [f"slides: {self.slides}, skipped: {self.skipped}, patches: {self.patches}, failures: {self.failures}"]
        return out + [f"[OK] {name}: {n} vectors" for name, n in self.features.items()]


class SlideEngine:
    """Plans over a folder of slides. ``masks`` may replace the segmenter by precomputed ones."""

    def __init__(self, spark: SparkSession, output: Output, segmentation: Segmentation | None = None, segmenter: Segmenter | None = None, registry: Registry | None = None) -> None:
        self.spark, self.output = spark, output
        self.segmentation = segmentation or Segmentation()
        self.segmenter = segmenter or saturation_segmenter()
        self.registry = registry or default_registry()
        ship(spark)

    def slides(self, path: str, recursive: bool = False, mpp_csv: str | None = None, mpp: float | None = None) -> DataFrame:
        """Slides with pixels, resolution and magnification, or an error. Overrides of the CSV go before ``mpp``."""
        listed = discover(self.spark, path, recursive).select("slide_id", "path", "backend")
        pyramids = F.col("backend") == "openslide"
        images = image_slides(self.spark, path, recursive).join(listed.where(~F.coalesce(pyramids, F.lit(False))).select("slide_id", "backend"), "slide_id")
        rows = images.unionByName(pyramid_slides(listed.where(pyramids)).withColumn("backend", F.lit("openslide")))
        rows = rows.withColumn("mpp", F.lit(mpp).cast("double"))
        if mpp_csv:
            overrides = read_mpp_csv(self.spark, mpp_csv).withColumnRenamed("mpp", "_csv")
            rows = rows.join(overrides, "stem", "left").withColumn("mpp", F.coalesce("_csv", "mpp")).drop("_csv")
        return with_resolution(rows).withColumn("slide_stem", F.col("stem"))

    def masks(self, slides: DataFrame) -> DataFrame:
        return segment(slides, self.segmenter, self.segmentation)

    def polygons(self, slides: DataFrame, masks: DataFrame, config: Extraction) -> DataFrame:
        """Tissue contours with their holes in level-0 coordinates, and the patch geometry of their slide."""
        found = ct.contours_of_masks(masks.where("error is null"), self.segmentation.mask_threshold)
        sizes = masks.where("error is null").select("slide_id", F.col("h").alias("mask_h"), F.col("w").alias("mask_w"))
        outer = found.where("kind = 'tissue'").join(sizes, "slide_id").withColumn("pixels", F.col("mask_h") * F.col("mask_w"))
        outer = ct.tissue_filter(outer, config.tissue_thresh, "pixels").select("slide_id", "contour_idx", "points", "mask_h", "mask_w")
        holes = found.where("kind = 'hole'").select("slide_id", F.col("contour_idx").alias("hole_idx"), "parent_idx", F.col("points").cast(_POLYGON).alias("points"))
        holes = ct.top_holes(holes.withColumn("area", geo.area(F.col("points")))).select("slide_id", "hole_idx", "parent_idx", "points")
        g = geo.patch_geometry(F.col("ds"), F.col("mag"), F.lit(config.target_mag), F.lit(config.patch_size), F.lit(config.step))
        plans = slides.where("error is null").select("slide_id", "slide_stem", "w", "h", "mag", g.alias("g")).where("g is not null")
        joined = ct.attach_holes(outer, holes).join(plans.select("slide_id", "slide_stem", "w", "h", "mag", "g.*"), "slide_id")
        sx, sy = F.col("w").cast("double") / F.col("mask_w"), F.col("h").cast("double") / F.col("mask_h")
        return joined.withColumns({"points": geo.scale_points(F.col("points"), sx, sy), "holes": F.transform("holes", lambda h: geo.scale_points(h, sx, sy))})

    def patches(self, slides: DataFrame, masks: DataFrame, config: Extraction) -> DataFrame:
        """Patches in tissue with ordinals and passports; without fast mode dark and blank ones go."""
        grid = gr.tissue_grid(self.polygons(slides, masks, config))
        if not config.fast_mode:
            numbered = gr.with_ordinals(grid)
            pixels = patch_pixels(slides, numbered, config.patch_size)
            dull = dark_mask(F.col("data"), config.black_thresh) | blank_mask(F.col("data"), config.white_thresh)
            grid = numbered.join(pixels.where(~dull).select("slide_id", "patch_idx"), ["slide_id", "patch_idx"], "left_semi").drop("patch_idx", "total")
        p = gr.with_ordinals(grid)
        label = gr.passport(F.col("slide_stem"), F.col("x"), F.col("y"), F.col("read"), F.col("read"), F.col("level"), F.col("mag"), F.lit(config.target_mag), F.col("total"))
        return p.withColumns({"read_w": F.col("read"), "read_h": F.col("read"), "passport": label})

    def failures(self, slides: DataFrame, masks: DataFrame | None, config: Extraction | None) -> DataFrame:
        """(path, stage, error) of slides that did not open, were not segmented or have no geometry."""
        out = slides.where("error is not null").select("path", F.lit("open").alias("stage"), "error")
        if masks is not None:
            bad = masks.where("error is not null").select("slide_id", F.col("error").alias("_why"))
            out = out.unionByName(slides.join(bad, "slide_id").select("path", F.lit("segment").alias("stage"), F.col("_why").alias("error")))
        if config is not None:
            why = geo.geometry_error(F.col("mag"), F.lit(config.target_mag))
            out = out.unionByName(slides.where("error is null").select("path", F.lit("extract").alias("stage"), why.alias("error")).where("error is not null"))
        return out

    def detect_tissue(self, path: str, recursive: bool = False, mpp_csv: str | None = None, mpp: float | None = None) -> Report:
        """Mask overlays of every slide."""
        with tables.only_run(self.spark, self.output.root):
            return self._detect(path, recursive, mpp_csv, mpp)

    def _detect(self, path: str, recursive: bool, mpp_csv: str | None, mpp: float | None) -> Report:
        slides = self.slides(path, recursive, mpp_csv, mpp)
        masks = self.masks(slides).persist()
        try:
            n = pictures.write_files(pictures.overlays(masks, None, None, slides), f"{self.output.root}/visualization")
            failures = self.failures(slides, masks, None)
            tables.write_failures(failures, self.output.root)
            return Report(slides=n // 2, failures=failures.count())
        finally:
            masks.unpersist()

    def segment_and_get_coords(self, path: str, config: Extraction, recursive: bool = False, mpp_csv: str | None = None, mpp: float | None = None) -> Report:
        """Coordinates, attributes and the pictures asked for, of slides that have none yet."""
        with tables.only_run(self.spark, self.output.root):
            return self._coords(path, config, recursive, mpp_csv, mpp)

    def _coords(self, path: str, config: Extraction, recursive: bool, mpp_csv: str | None, mpp: float | None) -> Report:
        root = self.output.root
        slides = self.slides(path, recursive, mpp_csv, mpp)
        every = slides.select("slide_id").count()
        if self.output.skip_existing:
            done = tables.read_attrs(self.spark, root).where("num_patches > 0").select("slide_id")
            slides = pending(slides, done, "slide_id")
        masks = self.masks(slides).persist()
        try:
            patches = self.patches(slides, masks, config).persist()
            tables.write_patches(patches, root)
            counts = patches.groupBy("slide_id").agg(F.count("*").alias("num_patches"))
            first = patches.groupBy("slide_id").agg(F.first("patch_l0").alias("patch_l0"))
            extra = metadata_attrs(F.col("meta"), F.col("mpp"), F.col("mag"))
            described = slides.where("error is null").join(first, "slide_id", "left").withColumn("extra", extra)
            self._pictures(slides, masks, patches, config)
            tables.write_attrs(tables.slide_attrs(described, counts, config), root)
            failures = self.failures(slides, masks, config)
            tables.write_failures(failures, root)
            ran = slides.select("slide_id").count()
            return Report(slides=ran, skipped=every - ran, patches=patches.count(), failures=failures.count())
        finally:
            masks.unpersist()

    def _pictures(self, slides: DataFrame, masks: DataFrame, patches: DataFrame, config: Extraction) -> None:
        """The pictures asked for. Each kind stands alone: one that fails leaves a failure for the run and costs no other kind."""
        out = self.output

        def images() -> None:
            pixels = patch_pixels(slides, patches, config.patch_size)
            pictures.write_files(pictures.patch_files(pixels, patches, config.patch_size), f"{out.root}/images")

        def outlines() -> DataFrame:
            contours = ct.contours_of_masks(masks.where("error is null"), self.segmentation.mask_threshold)
            return pictures.overlays(masks, contours, None, slides, masks_too=False)

        def grids() -> DataFrame:
            sizes = masks.where("error is null").select("slide_id", F.col("h").alias("_h"), F.col("w").alias("_w"))
            p = patches.join(sizes, "slide_id")
            dx, dy = F.col("w") / F.col("_w").cast("double"), F.col("h") / F.col("_h").cast("double")
            edge = {"x0": F.col("x") / dx, "y0": F.col("y") / dy, "x1": (F.col("x") + F.col("patch_l0")) / dx, "y1": (F.col("y") + F.col("patch_l0")) / dy}
            return pictures.overlays(masks, None, p.select("slide_id", *[v.cast("bigint").alias(k) for k, v in edge.items()]), slides, masks_too=False)

        drawn = lambda make: lambda: pictures.write_files(make(), f"{out.root}/visualization")
        kinds = [
            ("images", out.save_images, images),
            ("mask", out.visualize_mask, drawn(lambda: pictures.overlays(masks, None, None, slides))),
            ("contours", out.visualize_contours, drawn(outlines)),
            ("grids", out.visualize_grids, drawn(grids)),
        ]
        for name, asked, run in kinds:
            try:
                if asked:
                    run()
            except Exception as e:  # noqa: BLE001
                failed = self.spark.createDataFrame([(out.root, f"picture {name}", f"{type(e).__name__}: {str(e)[:500]}")], "path string, stage string, error string")
                tables.write_failures(failed, out.root)

    def process(self, path: str, config: Extraction, features: Features, recursive: bool = False, mpp_csv: str | None = None, mpp: float | None = None) -> Report:
        """Coordinates, then the vectors of every encoder for the slides that lack them."""
        with tables.only_run(self.spark, self.output.root):
            report = self._coords(path, config, recursive, mpp_csv, mpp)
            report.features = self.embed_all(self.slides(path, recursive, mpp_csv, mpp), config, features)
            return report

    def embed_all(self, slides: DataFrame, config: Extraction, features: Features) -> dict[str, int]:
        """Vectors written for each encoder, by name. An encoder that cannot be built leaves a failure for each slide it was to do."""
        root, out = self.output.root, {}
        asked = self.spark.createDataFrame([(e,) for e in features.encoders], "encoder string")
        ready = tables.read_attrs(self.spark, root).where("num_patches > 0").select("slide_id", "slide_stem")
        missing = missing_features(ready, asked, complete_encoders(tables.feature_counts(self.spark, root))).persist()
        try:
            for name in features.encoders:
                own = missing.where(F.col("encoder") == name.lower()).select("slide_id")
                if own.isEmpty():
                    out[name] = 0
                    continue
                try:
                    encoder = self.registry.create(name)
                except Exception as e:  # noqa: BLE001
                    failed = slides.join(own, "slide_id").select("path", F.lit("embed").alias("stage"), F.lit(f"{name}: {e}").alias("error"))
                    tables.write_failures(failed, root)
                    out[name] = 0
                    continue
                patches = tables.read_patches(self.spark, root).join(own, "slide_id", "left_semi").withColumn("read", F.col("read_w"))
                vectors = embed(patch_pixels(slides, patches, config.patch_size), encoder, config.patch_size, features.batch_size)
                named = vectors.join(F.broadcast(ready.join(own, "slide_id")) if own.count() < 100_000 else ready.join(own, "slide_id"), "slide_id")
                tables.write_features(named, root, name)
                stored = tables.read_features(self.spark, root).where(F.col("encoder") == name.lower())
                out[name] = stored.join(own, "slide_id", "left_semi").count()
        finally:
            missing.unpersist()
        return out
