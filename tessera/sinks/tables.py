"""Result tables of a run: patches, attributes, features and failures as partitioned Parquet.

A write replaces the partitions it has rows for and no other, and Spark's
committer publishes files only when the job succeeds, so a run that is cut off
leaves the former state and a rerun repeats only what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Extraction

PASSPORT_VERSION = 2
ATTRS_SCHEMA = "slide_stem string, slide_id bigint, num_patches bigint, attrs map<string,string>"


@contextmanager
def only_run(spark: SparkSession, root: str) -> Iterator[None]:
    """Holds the file ``run.lock`` below ``root``; another run that writes there meanwhile is refused.

    The file is created or refused in one step, also on HDFS. It goes with the run, or with the driver's JVM; one
    that a machine failure left behind names its application and is removed by hand.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run.lock")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.createNewFile(path):
        raise RuntimeError(f"another run writes to {root}; if none does, remove {path.toString()}")
    files.deleteOnExit(path)
    try:
        yield
    finally:
        files.delete(path, False)


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_patches(patches: DataFrame, root: str) -> None:
    """Coordinates and passports, one folder for each slide; a slide's rows are sorted by patch_idx."""
    columns = ["slide_stem", "slide_id", "patch_idx", "x", "y", "read_w", "read_h", "level", "passport"]
    _replace(patches.select(*columns).repartition("slide_stem").sortWithinPartitions("slide_stem", "patch_idx"), f"{root}/patches", "slide_stem")


def slide_attrs(slides: DataFrame, counts: DataFrame, config: Extraction, created: datetime | None = None) -> DataFrame:
    """ATTRS_SCHEMA: ``slides`` has slide_id, slide_stem, path, w, h, mag, patch_l0, extra (a map); counts slide_id, num_patches.

    Values are text; unknown ones are "None".
    """
    when = (created or datetime.now(timezone.utc)).isoformat()
    fixed = {"patch_size": config.patch_size, "target_magnification": config.target_mag, "overlap": max(0, config.patch_size - config.step), "passport_version": PASSPORT_VERSION, "creation_date": when}
    known = {"wsi_path": "path", "level0_width": "w", "level0_height": "h", "level0_magnification": "mag", "patch_size_level0": "patch_l0"}
    pairs = [c for k, v in fixed.items() for c in (F.lit(k), F.lit(str(v)))]
    pairs += [c for k, v in known.items() for c in (F.lit(k), F.coalesce(F.col(v).cast("string"), F.lit("None")))]
    joined = slides.join(counts, "slide_id", "left")
    return joined.select("slide_stem", "slide_id", F.coalesce("num_patches", F.lit(0)).cast("bigint").alias("num_patches"), F.map_concat(F.create_map(*pairs), "extra").alias("attrs"))


def write_attrs(attrs: DataFrame, root: str) -> None:
    """Written after the patches: a slide without attributes has no finished output."""
    _replace(attrs.withColumn("part", F.pmod(F.xxhash64("slide_stem"), F.lit(64)).cast("int")), f"{root}/attrs/run={datetime.now(timezone.utc):%Y%m%d%H%M%S%f}", "part")


def write_features(features: DataFrame, root: str, encoder: str) -> None:
    """Vectors of one encoder (slide_stem, patch_idx, embedding); a slide's partial set is replaced."""
    rows = features.select(F.lit(encoder.lower()).alias("encoder"), "slide_stem", "slide_id", "patch_idx", "embedding")
    _replace(rows.repartition("slide_stem").sortWithinPartitions("slide_stem", "patch_idx"), f"{root}/features", "encoder", "slide_stem")


def write_failures(failures: DataFrame, root: str) -> None:
    """Dead letters (path, stage, error) are appended."""
    failures.select("path", "stage", "error").write.mode("append").parquet(f"{root}/failures")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_patches(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/patches", "slide_id bigint, patch_idx bigint, x bigint, y bigint, read_w bigint, read_h bigint, level bigint, passport string, slide_stem string")


def read_attrs(spark: SparkSession, root: str) -> DataFrame:
    """Attributes of the last run that wrote each slide."""
    rows = _read(spark, f"{root}/attrs", f"{ATTRS_SCHEMA}, run string, part int")
    newest = F.max_by(F.struct("slide_id", "num_patches", "attrs"), "run").alias("a")
    return rows.groupBy("slide_stem").agg(newest).select("slide_stem", "a.*")


def read_features(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/features", "slide_id bigint, patch_idx bigint, embedding array<float>, encoder string, slide_stem string")


def feature_counts(spark: SparkSession, root: str) -> DataFrame:
    """(slide_id, encoder, n_rows, expected_total) of what is stored; vectors are not read."""
    rows = read_features(spark, root).groupBy("slide_id", "encoder").agg(F.count("*").alias("n_rows"))
    return rows.join(read_attrs(spark, root).select("slide_id", F.col("num_patches").alias("expected_total")), "slide_id")
