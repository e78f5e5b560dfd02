"""What is done already and what is missing: the algebra of resumed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that slides are numbered in, at most, and values drawn for each of them to set their bounds; every slide is in one.
MAX_RANGES, DRAWN = 64, 50


def existing_outputs(attrs: DataFrame, patches: DataFrame) -> DataFrame:
    """(slide_stem, num_patches) of slides with patches: the recorded number, else a count; none at all means redo."""
    counted = patches.groupBy("slide_stem").agg(F.count("*").alias("counted"))
    both = attrs.select("slide_stem", "num_patches").join(counted, "slide_stem", "full")
    return both.select("slide_stem", F.coalesce("num_patches", "counted").alias("num_patches")).where("num_patches > 0")


def pending(slides: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """Slides without an output."""
    return slides.join(done.select(key), key, "left_anti")


def complete_encoders(outputs: DataFrame, slide: str = "slide_id") -> DataFrame:
    """(slide, encoder) with as many rows as the slide has patches; ``outputs``: slide, encoder, n_rows, expected_total."""
    return outputs.where("n_rows = expected_total").select(slide, F.lower("encoder").alias("encoder"))


def missing_features(slides: DataFrame, encoders: DataFrame, complete: DataFrame, slide: str = "slide_id") -> DataFrame:
    """(slide, encoder) still to be computed; ``encoders`` is the short list asked for, replicated, not joined."""
    asked = encoders.agg(F.sort_array(F.collect_set(F.lower("encoder"))).alias("asked"))
    wanted = slides.select(slide).distinct().join(F.broadcast(asked)).select(slide, F.explode("asked").alias("encoder"))
    return wanted.join(complete, [slide, "encoder"], "left_anti")


def progress(slides: DataFrame, required: list[str], complete: DataFrame, slide: str = "slide_id") -> DataFrame:
    """(required_units, done_units, missing_units) over all slides."""
    have = complete.where(F.col("encoder").isin([r.lower() for r in required])).groupBy(slide).agg(F.count_distinct("encoder").alias("n"))
    per_slide = slides.select(slide).distinct().join(have, slide, "left")
    total = per_slide.agg(F.count("*").alias("slides"), F.coalesce(F.sum("n"), F.lit(0)).alias("done_units"))
    need = F.col("slides") * len(required)
    return total.select(need.alias("required_units"), "done_units", (need - F.col("done_units")).alias("missing_units"))


def _part_of(column: str, bounds: list[str]) -> Column:
    """Number of ``bounds`` that are not above the column, by halves; null counts as above all."""

    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) < F.lit(bounds[mid]), halves(low, mid)).otherwise(halves(mid + 1, high))

    return halves(0, len(bounds))


def batches(slides: DataFrame, size: int, order: str) -> DataFrame:
    """``slides`` with batch_no: runs of ``size`` slides by ``order``, nulls last; slides that tie there go by their other columns.

    Slides are numbered within ranges of ``order`` and the counts of the ranges before are added, so no task sees
    all slides. A range is told by a slide's own value and bounds that are fixed here: partition numbers of a
    sort differ between the branches of a plan that count and number them.
    """
    spark = slides.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    known = slides.select(order).where(F.col(order).isNotNull())
    drawn = sorted(r[0] for r in known.orderBy(F.xxhash64(order)).limit(DRAWN * parts).collect())
    bounds = sorted(set(drawn[DRAWN::DRAWN]))
    placed = slides.withColumn("_part", _part_of(order, bounds))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_last(), *[c for c in slides.columns if c != order])
    out = placed.withColumn("_row", F.row_number().over(within)).join(F.broadcast(before), "_part")
    return out.withColumn("batch_no", F.floor((F.col("_before") + F.col("_row") - 1) / size)).drop("_part", "_row", "_before")
