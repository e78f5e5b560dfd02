"""Exact deduplication through an extendible-hash index on shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Workspace, small, table, text_or_empty

#: Keys that a bucket of the directory may hold before it is split.
BUCKET_KEYS = 8192


def normalised(text: str) -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def build_directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Directory of an extendible hash over the column ``key`` (one row for each distinct key).

    Returns slot, bucket, local_depth, keys. The directory has 2^d slots, the
    top d bits of a key choosing its slot; slots of a bucket that never
    overflowed share it at a smaller local depth. A bucket above ``capacity`` is
    split by one more bit, doubling the directory as often as needed; d is set
    by the number of keys, so only a hash far from uniform leaves a bucket
    above capacity, and that bucket is still whole.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)) + 2) if total > capacity else 0
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    cells = keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    levels = cells.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - d)"))
    sizes = levels.groupBy("d", "prefix").agg(F.sum("n").alias("keys"))
    fits = levels.join(sizes, ["d", "prefix"]).where((F.col("keys") <= capacity) | (F.col("d") == depth))
    leaf = fits.groupBy("slot").agg(F.min(F.struct("d", "prefix", "keys")).alias("leaf"))
    bucket = F.expr(f"shiftleft(leaf.prefix, {depth} - leaf.d)")
    return leaf.select("slot", bucket.alias("bucket"), F.col("leaf.d").alias("local_depth"), F.col("leaf.keys").alias("keys"), F.lit(depth).alias("depth"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, key_bits: int = 64, digest_chars: int = 64, directory: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree byte for byte once white space is deleted;
    null counts as empty. The row with most code points in the original text
    stays, then the smallest id (null ids last). Rows that agree in id and
    text are one record twice: both carry the same answer. Other columns of
    ``docs`` are ignored, whatever their names; an empty table gives no rows.

    Method: the index file holds (id, code points, 64-bit key, SHA-256) of every
    row. Its directory gives each key that occurs more than once a bucket,
    which is a range of keys, and the rows of a bucket go to the one task that owns it.
    The owner chains the texts of a key and tells them apart by their bytes.
    Before rows are dealt, copies of a text in one input task become one row, so a group
    with a third of all rows sends one text for each task. Texts of keys seen once
    are chains of one and never move. ``key_bits`` and ``digest_chars`` weaken the hashes so
    that tests can force collisions; ``directory`` stands in for build_directory's.
    """
    work = Workspace(docs.sparkSession, "exact_dedup")
    norm = normalised("text")
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.length(text_or_empty("text")).alias("n_chars"), norm.alias("norm"))
    keyed = base.withColumn("sha", F.sha2("norm", 256)).withColumn("key", key).withColumn("digest", F.unhex(F.substring("sha", 1, digest_chars)))
    entries = work.stage(keyed.select("id", "n_chars", "key", "digest", F.unhex("sha").alias("sha")), "entries")
    counts = work.stage(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    directory = work.stage(build_directory(counts, capacity) if directory is None else directory, "directory")
    depth = (directory.agg(F.max("depth")).first()[0]) or 0
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    routed = counts.where("n > 1").select("key", slot.alias("slot")).join(small(directory.select("slot", "bucket")), "slot").select("key", "bucket")
    routed = work.stage(routed, "routed")

    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("other"))).alias("best")
    rows = keyed.select("id", "n_chars", "key", "digest", "norm", F.spark_partition_id().alias("task")).join(small(routed), "key")
    sent = rows.groupBy("task", "bucket", "key", "digest", "norm").agg(F.count("*").alias("n"), best)
    owned = sent.repartition("bucket").groupBy("bucket", "key", "digest", "norm").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    # Different texts under one key and digest: their rows carry the text itself.
    several = F.count("*").over(Window.partitionBy("bucket", "key", "digest")) > 1
    chains = work.stage(owned.select("bucket", "key", "digest", "n", "best", F.when(several, F.col("norm")).otherwise(F.lit("")).alias("chain")), "chains")
    clashes = work.stage(chains.where("chain != ''").select("key", "digest").distinct(), "clashes")
    if clashes.isEmpty():
        entries = entries.withColumn("chain", F.lit(""))
    else:
        texts = keyed.join(clashes.withColumn("clash", F.lit(True)), ["key", "digest"], "left").withColumn("chain", F.when(F.col("clash"), F.col("norm")).otherwise(F.lit("")))
        entries = work.stage(texts.select("id", "n_chars", "key", "digest", F.unhex("sha").alias("sha"), "chain"), "chained")

    groups = chains.where("n > 1").select("key", "digest", "chain", "n", "best")
    out = entries.join(small(groups), ["key", "digest", "chain"], "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.bitwise_not("best.other"))
    kept = alone | (F.col("id").eqNullSafe(F.bitwise_not("best.other")) & (F.col("n_chars") == F.col("best.n_chars")))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
