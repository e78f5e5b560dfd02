"""Slide operators on tables larger than the smallest ones, and under other plans."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.operators import resume as rs
from tessera.plans.registry import QUERIES


def test_batches_follow_the_order_at_any_size(spark):
    """A range sort has other bounds in each branch of a plan once its sample is not the whole table."""
    n = 300_000
    slides = spark.range(n).select(F.format_string("slide_%07d", F.pmod(F.xxhash64("id"), F.lit(9_999_991))).alias("filename"), "id", F.lit("x" * 40).alias("other"))
    got = rs.batches(slides.repartition(16), 16, "filename")
    rows = got.select("filename", "id", "batch_no").toPandas().sort_values(["filename", "id"])
    assert rows["batch_no"].tolist() == [k // 16 for k in range(n)]


def test_batches_of_ties_and_nulls(spark):
    slides = spark.createDataFrame([("b", 4), (None, 1), ("a", 3), ("b", 2), (None, 0), ("a", 7)], "filename string, id long")
    got = {r["id"]: r["batch_no"] for r in rs.batches(slides, 2, "filename").collect()}
    assert got == {3: 0, 7: 0, 2: 1, 4: 1, 0: 2, 1: 2}
    assert rs.batches(slides.limit(0), 2, "filename").count() == 0


@pytest.mark.parametrize("name", ["hole_topk", "in_tissue", "patch_counts", "duplicate_patches", "passports", "grid_overlay_boxes"])
def test_slides_are_dealt_to_all_cores(spark, sf, name):
    """A table of slides is one small file, which was one task with all the work on contours and holes behind it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        sizes = QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) >= 6


def test_rows_of_a_polygon_decide_as_its_edges(spark):
    """Random polygons with level, upright, repeated and crossing edges; every point of a box around them."""
    rng = random.Random(8)
    shapes = [[(rng.randrange(-6, 7), rng.randrange(-6, 7)) for _ in range(rng.randrange(1, 9))] for _ in range(60)] + [[(0, 0), (4, 0), (4, 4), (0, 4)]]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(shapes)], "id long, points array<struct<x:bigint,y:bigint>>")
    span = F.sequence(F.lit(-7).cast("long"), F.lit(7).cast("long"))
    points = rows.select("id", geo.edges_of(F.col("points")).alias("edges"), F.explode(span).alias("y")).select("*", F.explode(span).alias("x"))
    row, old = geo.row_of(F.col("edges"), F.col("y")), [F.col("edges"), F.col("x"), F.col("y")]
    inside, on = geo.row_inside(F.col("row"), F.col("x")), geo.row_on(F.col("row"), F.col("x"))
    both = points.withColumn("row", row).select((inside | on).alias("a"), geo.touches(*old).alias("b"), (inside & ~on).alias("c"), geo.strictly_inside(*old).alias("d"))
    counts = {(r["a"], r["c"]): r["count"] for r in both.groupBy("a", "c").count().collect()}
    assert both.where("a != b or c != d").count() == 0
    assert len(counts) == 3


def test_area_of_known_corners(spark):
    corners = [(0, 0), (5, 1), (7, 6), (2, 4)]
    as_columns = [(F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in corners]
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in as_columns])
    assert spark.range(1).select(geo.area_of(as_columns) == geo.area(points)).first()[0]
