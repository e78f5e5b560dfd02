"""Resolution overrides from a CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metadata import number
from tessera.functions.paths import stem_of


def mpp_overrides(rows: DataFrame) -> DataFrame:
    """(stem, mpp) from rows (row_no, wsi, mpp as text): blank or bad ones are left out, the last of a stem counts."""
    value = number(F.trim("mpp"))
    good = rows.where((F.trim("wsi") != "") & (value > 0)).select(stem_of(F.trim("wsi")).alias("stem"), value.alias("mpp"), "row_no")
    return good.groupBy("stem").agg(F.max_by("mpp", "row_no").alias("mpp"))


def read_mpp_csv(spark: SparkSession, path: str) -> DataFrame:
    """Overrides of a CSV file with columns wsi and mpp; an error if they are missing or no row is good."""
    rows = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in rows.columns}
    if not {"wsi", "mpp"} <= set(names):
        raise ValueError(f"{path} needs the columns wsi and mpp")
    numbered = rows.select(F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(f"`{names['wsi']}`"), F.lit("")).alias("wsi"), F.coalesce(F.col(f"`{names['mpp']}`"), F.lit("")).alias("mpp"))
    out = mpp_overrides(numbered)
    if out.isEmpty():
        raise ValueError(f"{path} has no valid row")
    return out


def attach_mpp(slides: DataFrame, overrides: DataFrame, manual: str = "mpp_meta") -> DataFrame:
    """``slides`` (stem and a resolution from metadata) with mpp: the override if there is one."""
    return slides.join(overrides.withColumnRenamed("mpp", "_csv"), "stem", "left").withColumn("mpp", F.coalesce("_csv", manual)).drop("_csv")
