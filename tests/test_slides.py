"""Slide operators: kernels by hand, boundaries, and whole runs over generated images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.cli import encoder_names, main
from tessera.config import Extraction, Features, Output, Segmentation
from tessera.functions import geometry as geo
from tessera.functions import metadata as md
from tessera.functions.pixels import as_bytes, is_black, is_white, resample
from tessera.operators.contours import mask_to_contours
from tessera.pipeline import SlideEngine
from tessera.plans.catalog import Encoder, MissingDependency, Registry, default_registry, rgb_stats
from tessera.sinks import tables
from tessera.sinks.pictures import png
from tessera.sources.slides import Backends, PyramidSource, crop, discover, region_reads, stem_collisions
from tessera.streaming.discovery import append_new_slides


def test_contours_of_a_ring_and_a_dot():
    mask = np.zeros((9, 12), bool)
    mask[1:7, 1:7] = True
    mask[3:5, 3:5] = False
    mask[7, 10] = True
    outer, holes = mask_to_contours(mask)
    assert [min(c) for c in outer] == [(1, 1), (10, 7)]
    assert len(outer[0]) == 20 and outer[1] == [(10, 7)]
    assert len(holes) == 1 and holes[0][0] == 0
    assert {(2, 3), (5, 4), (3, 2), (4, 5)} <= set(holes[0][1])
    assert mask_to_contours(np.zeros((4, 4), bool)) == ([], [])


def test_polygon_area_covers_the_mask():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((14, 14)) > 0.5
        outer, holes = mask_to_contours(mask)
        border = {p for c in outer for p in c} | {p for _, c in holes for p in c}
        assert all(mask[y, x] for x, y in border)
        assert all(0 <= parent < len(outer) for parent, _ in holes)


@pytest.mark.parametrize("mpp, mag", [(0.1, 80), (0.1599, 80), (0.16, 60), (0.2, 40), (0.3, 20), (0.6, 10), (1.2, 5), (2.4, None)])
def test_magnification_steps(spark, mpp, mag):
    row = spark.range(1).select(md.infer_mag(F.lit(mpp)).alias("m"), md.mpp_error(F.lit(mpp)).alias("e")).first()
    assert (row["m"], row["e"]) == (mag, None)


def test_levels_and_rounding(spark):
    ds = F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    level = lambda t: geo.optimal_level(ds, F.lit(t))
    rows = spark.range(1).select(*[level(t).alias(f"t{i}") for i, t in enumerate((2.0099, 2.0101, 0.5, 9.0))], geo.half_even(F.lit(2.5)).alias("r")).first()
    assert [(rows[f"t{i}"]["level"], round(rows[f"t{i}"]["extra"], 6)) for i in range(4)] == [(1, 1.0), (1, 1.00505), (0, 2.0), (2, 2.25)]
    assert rows["r"] == 2


def test_probe_on_edges(spark):
    square = F.array(*[F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    edges = geo.edges_of(square)
    for (x, y), touch, inside in (((0, 5), True, False), ((10, 10), True, False), ((5, 5), True, True), ((11, 5), False, False)):
        row = spark.range(1).select(geo.touches(edges, F.lit(x), F.lit(y)).alias("t"), geo.strictly_inside(edges, F.lit(x), F.lit(y)).alias("s")).first()
        assert (row["t"], row["s"]) == (touch, inside)


def test_pixel_kernels():
    x = np.zeros((10, 10, 3), np.uint8)
    x[:3] = 255
    assert is_black(x, 50) and not is_white(x, 15)
    x[:4] = 255
    assert not is_black(x, 50)
    assert is_white(np.full((4, 4, 3), 255, np.uint8), 15)
    flat = np.full((6, 8, 3), 77, np.uint8)
    for how in ("area", "cubic", "linear", "nearest", "other"):
        assert (resample(flat, 3, 5, how) == 77).all() and resample(flat, 13, 4, how).shape == (13, 4, 3)
    assert as_bytes(np.ones((3, 5, 7), np.float32)).tolist() == np.full((5, 7, 3), 255).tolist()
    assert crop(flat, -2, 4, 4, 4).sum() == 77 * 3 * 4


def test_registry_and_encoders():
    registry = default_registry()
    assert len(registry.available()) == 66 and registry.available() == sorted(registry.available())
    with pytest.raises(MissingDependency):
        registry.create("uni_v1")
    with pytest.raises(KeyError):
        registry.create("nothing")
    with pytest.raises(ValueError):
        registry.register("UNI_V1", 3, lambda: None)
    assert Encoder("e", 6, rgb_stats).extract_batch(np.zeros((0, 4, 4, 3), np.uint8)).shape == (0, 6)
    with pytest.raises(TypeError):
        Encoder("e", 6, list).extract_batch(np.zeros((2, 4, 4, 3), np.uint8))
    with pytest.raises(ValueError):
        Encoder("e", 5, rgb_stats).extract_batch(np.zeros((2, 4, 4, 3), np.uint8))


def test_backends():
    b = Backends()
    b.register("image", lambda path, **o: ("image", path))

    def broken(path, **o):
        raise OSError("no")

    b.register("other", broken)
    assert b.detect("/a/b.SVS") == "openslide" and b.detect("/a/b") is None
    assert b.load("/x.png") == ("image", "/x.png")
    for bad in ("/x.svs", "/x.txt"):
        with pytest.raises(ValueError):
            b.load(bad)
    b.map_suffix(".TXT", "image")
    assert b.load("/x.txt")[0] == "image" and b.try_load("/x.y", ["other", "image"])[0] == "image"
    with pytest.raises(ValueError, match="other: no"):
        b.try_load("/x", ["other"])


@pytest.mark.parametrize("make", [
    lambda: Extraction(0, 20), lambda: Extraction(256, 121), lambda: Extraction(256, 20, tissue_thresh=1.1), lambda: Segmentation(device="gpu"),
    lambda: Features(()), lambda: Features(("a", "a")), lambda: Features(("a",), precision="int8"), lambda: Features(("a",), num_workers=-1), lambda: Output(""),
])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()
    assert Features(("a",), device="cpu").compute_dtype == "float32" and Extraction(256, 20).step == 256


def test_command_line(capsys):
    assert main(["info"]) == 0 and "openslide" in capsys.readouterr().out
    assert main(["process", "/none", "-o", "/tmp/x", "--write-batch", "9", "--patch-workers", "2", "--max-open-slides", "3", "--patch-size", "0", "--target-mag", "20", "--feature-extractors", "uni_v1"]) == 2
    assert encoder_names("UNI_V1, resnet50", ["uni_v1", "resnet50"]) == ("uni_v1", "resnet50")
    for bad in (" , ", "a", "uni_v1 uni_v1"):
        with pytest.raises(ValueError):
            encoder_names(bad, ["uni_v1"])


@pytest.fixture()
def folder(tmp_path):
    """Two slides with tissue, one blank one, a broken one, a text file and a nested folder with an equal stem."""
    rng = np.random.default_rng(4)

    def slide(w, h, boxes):
        x = np.full((h, w, 3), 250, np.uint8)
        for x0, y0, x1, y1 in boxes:
            x[y0:y1, x0:x1] = rng.integers(60, 200, (y1 - y0, x1 - x0, 1)) * np.array([1.0, 0.4, 0.8])
        return png(x)

    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "one.png").write_bytes(slide(640, 480, [(64, 64, 400, 300)]))
    (src / "two.PNG").write_bytes(slide(320, 320, [(0, 0, 120, 120), (200, 200, 300, 300)]))
    (src / "blank.png").write_bytes(slide(200, 100, []))
    (src / "broken.jpg").write_bytes(b"not a picture")
    (src / "notes.txt").write_text("x")
    (src / "sub" / "one.png").write_bytes(slide(64, 64, [(0, 0, 64, 64)]))
    return tmp_path


def test_discovery(spark, folder):
    rows = discover(spark, str(folder / "in")).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in rows] == ["blank.png", "broken.jpg", "one.png", "two.PNG"]
    nested = discover(spark, str(folder / "in"), recursive=True)
    assert nested.count() == 5 and [tuple(r) for r in stem_collisions(nested).collect()] == [("one", 2)]
    (folder / "empty").mkdir()
    (folder / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        discover(spark, str(folder / "empty"))


def test_pyramids_need_their_package(spark):
    spark.dataSource.register(PyramidSource)
    row = spark.read.format("pyramid").option("paths", "/none/a.svs").load().first()
    assert row["w"] is None and row["error"]


FAKE = '''
"""A stand-in for the package that opens pyramids: a file names its properties, level 0 is a pattern of its coordinates."""
import json
import numpy as np


class OpenSlide:
    def __init__(self, path):
        with open(path) as f:
            self.properties = json.load(f)
        self.level_dimensions, self.level_downsamples = ((640, 480), (320, 240), (160, 120)), (1.0, 2.0, 4.0)

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def close(self):
        pass

    def read_region(self, at, level, size):
        down = int(self.level_downsamples[level])
        y, x = np.mgrid[at[1] : at[1] + size[1] * down : down, at[0] : at[0] + size[0] * down : down]
        out = np.stack([x % 200 + 20, y % 100, (x + y) % 50, np.full(x.shape, 255)], axis=-1)
        out[(x < 0) | (y < 0) | (x >= 640) | (y >= 480)] = 0
        tissue = (x >= 64) & (x < 400) & (y >= 64) & (y < 300)
        out[~tissue & (out[..., 3] > 0)] = (250, 250, 250, 255)
        return out.astype(np.uint8)
'''


@pytest.fixture(scope="module")
def pyramids(spark, tmp_path_factory):
    """A folder of two pyramids, one without a resolution, one that does not open, and a stand-in for their package."""
    top = tmp_path_factory.mktemp("pyramids")
    (top / "openslide.py").write_text(FAKE)
    spark.sparkContext.addPyFile(str(top / "openslide.py"))
    src = top / "in"
    src.mkdir()
    (src / "a.svs").write_text('{"openslide.mpp-x": "0.25", "openslide.objective-power": "40", "openslide.vendor": "maker"}')
    (src / "b.ndpi").write_text("{}")
    (src / "c.mrxs").write_text("not a slide")
    return top


def test_pyramids_end_to_end(spark, pyramids):
    root = str(pyramids / "out")
    registry = Registry()
    registry.register_function("rgb_stats", 6, rgb_stats)
    engine = SlideEngine(spark, Output(root, visualize_mask=True), Segmentation(device="cpu", thumbnail_power=10.0), registry=registry)
    report = engine.process(str(pyramids / "in"), Extraction(64, 20), Features(("rgb_stats",), device="cpu"))
    assert (report.slides, report.failures) == (3, 2)
    patches = tables.read_patches(spark, root).toPandas()
    assert set(patches["slide_stem"]) == {"a"} and set(patches["level"]) == {1} and len(patches) == report.features["rgb_stats"] > 5
    attrs = {r["slide_stem"]: r for r in tables.read_attrs(spark, root).collect()}["a"]["attrs"]
    assert attrs["vendor"] == "maker" and attrs["magnification"] == "40" and float(attrs["mpp"]) == 0.25
    assert {r["stage"] for r in spark.read.parquet(f"{root}/failures").collect()} == {"open"}
    # b.ndpi has no resolution of its own; an override gives it one.
    slides = engine.slides(str(pyramids / "in"), mpp=0.5)
    assert {r["stem"]: (r["mag"], r["error"] is None) for r in slides.select("stem", "mag", "error").collect() if r["stem"] != "c"} == {"a": (40, True), "b": (20, True)}
    one = slides.where("stem = 'a'")
    regions = one.select("slide_id").join(spark.createDataFrame([(1, 100, 80, 0, 3, 2), (2, 100, 80, 2, 3, 2), (3, -2, -2, 0, 2, 2)], "region_id long, x long, y long, level int, w long, h long"))
    got = {r["region_id"]: np.frombuffer(r["data"], np.uint8).reshape(2, -1, 3) for r in region_reads(one, regions).collect()}
    assert got[1][0].tolist() == [[120, 80, 30], [121, 80, 31], [122, 80, 32]] and got[2][1].tolist() == [[120, 84, 34], [124, 84, 38], [128, 84, 42]] and got[3].max() == 0


def test_a_failing_picture_costs_no_other(spark, folder, monkeypatch):
    from tessera.sinks import pictures

    def broken(*a, **b):
        raise OSError("disk is full")

    monkeypatch.setattr(pictures, "patch_files", broken)
    root = str(folder / "pictured")
    engine = SlideEngine(spark, Output(root, save_images=True, visualize_mask=True), Segmentation(device="cpu", thumbnail_power=5.0))
    assert engine.segment_and_get_coords(str(folder / "in"), Extraction(64, 20), mpp=0.5).patches > 5
    assert tables.read_attrs(spark, root).count() == 3
    assert ("picture images", "OSError: disk is full") in {(r["stage"], r["error"]) for r in spark.read.parquet(f"{root}/failures").collect()}
    assert (folder / "pictured" / "visualization" / "one_mask.png").exists()


def test_one_run_at_a_time(spark, folder):
    root = str(folder / "shared")
    engine = SlideEngine(spark, Output(root), Segmentation(device="cpu"))
    with tables.only_run(spark, root), pytest.raises(RuntimeError, match="another run"):
        engine.segment_and_get_coords(str(folder / "in"), Extraction(64, 20), mpp=0.5)
    assert not (folder / "shared" / "run.lock").exists()


def test_streamed_discovery(spark, folder):
    out, check = str(folder / "listing"), str(folder / "check")
    append_new_slides(spark, str(folder / "in"), out, check).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    (folder / "in" / "three.tif").write_bytes(b"x")
    append_new_slides(spark, str(folder / "in"), out, check).awaitTermination(120)
    assert sorted(r["stem"] for r in spark.read.parquet(out).select("stem").collect()) == ["blank", "broken", "one", "one", "three", "two"]


def test_whole_run_and_resume(spark, folder):
    root = str(folder / "out")
    registry = Registry()
    registry.register_function("rgb_stats", 6, rgb_stats)
    registry.register("absent", 3, lambda: (_ for _ in ()).throw(MissingDependency("not here")))
    engine = SlideEngine(spark, Output(root, save_images=True, visualize_grids=True, visualize_mask=True, visualize_contours=True), Segmentation(device="cpu", thumbnail_power=5.0), registry=registry)
    config, features = Extraction(64, 20, fast_mode=False), Features(("rgb_stats", "absent"), device="cpu", batch_size=7)
    report = engine.process(str(folder / "in"), config, features, mpp=0.5)
    assert (report.slides, report.skipped) == (4, 0) and report.failures == 1
    patches = tables.read_patches(spark, root).toPandas()
    assert set(patches["slide_stem"]) == {"one", "two"} and len(patches) == report.patches > 10
    for stem, own in patches.groupby("slide_stem"):
        assert sorted(own["patch_idx"]) == list(range(len(own)))
        assert all(p.endswith(f"_mag20_tmag20_total{len(own)}") and p.startswith(f"{stem}__x") for p in own["passport"])
    attrs = {r["slide_stem"]: r for r in tables.read_attrs(spark, root).collect()}
    assert attrs["blank"]["num_patches"] == 0 and attrs["one"]["attrs"]["patch_size"] == "64" and attrs["blank"]["attrs"]["patch_size_level0"] == "None"
    vectors = tables.read_features(spark, root)
    assert vectors.count() == len(patches) == report.features["rgb_stats"] and report.features["absent"] == 0
    assert {len(r["embedding"]) for r in vectors.collect()} == {6}
    stages = {r["stage"] for r in spark.read.parquet(f"{root}/failures").collect()}
    assert stages == {"open", "embed"}
    assert len(list((folder / "out" / "images").rglob("*.png"))) == len(patches)
    names = {p.name for p in (folder / "out" / "visualization").iterdir()}
    assert {f"one{k}.png" for k in ("_mask", "_mask_bw", "_contours", "_grid")} <= names
    again = engine.process(str(folder / "in"), config, Features(("rgb_stats",), device="cpu"), mpp=0.5)
    assert again.skipped == 2 and again.patches == 0 and again.features["rgb_stats"] == 0
    assert tables.read_features(spark, root).count() == len(patches)


def test_tissue_overlays(spark, folder):
    engine = SlideEngine(spark, Output(str(folder / "seen")), Segmentation(device="cpu", batch_size=2), segmenter=lambda images: [np.ones(x.shape[:2], np.float32) for x in images])
    assert engine.detect_tissue(str(folder / "in"), mpp=0.5).slides == 3
    assert len(list((folder / "seen" / "visualization").glob("*_mask.png"))) == 3
