"""Alignment, checks and pooling of patch features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_features(patches: DataFrame, features: DataFrame, slide: str = "slide_id") -> DataFrame:
    """Coordinates with their feature vectors, by (slide, patch_idx)."""
    return patches.join(features, [slide, "patch_idx"])


def width_check(features: DataFrame, slide: str = "slide_id", vector: str = "embedding") -> DataFrame:
    """(slide, rows, min_dim, max_dim, consistent) of each feature set."""
    size = F.size(vector)
    out = features.groupBy(slide).agg(F.count("*").alias("n_rows"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    return out.withColumn("consistent", F.col("min_dim") == F.col("max_dim"))


def cls_mean_pool(tokens: Column, registers: int = 0) -> Column:
    """First token joined to the mean of the patch tokens behind ``registers`` extra ones (array<array<double>>)."""
    patches = F.slice(tokens, 2 + registers, F.greatest(F.size(tokens) - 1 - registers, F.lit(0)))
    width = F.size(F.get(tokens, F.lit(0)))
    sums = F.aggregate(patches, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return F.concat(F.get(tokens, F.lit(0)), F.transform(sums, lambda v: v / F.size(patches)))


def mean_pool(tokens: Column) -> Column:
    """Mean over all positions of a grid of tokens."""
    width = F.size(F.get(tokens, F.lit(0)))
    sums = F.aggregate(tokens, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return F.transform(sums, lambda v: v / F.size(tokens))
