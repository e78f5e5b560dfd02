"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Distinct records that one window partition numbers, on average.
CELL_ROWS = 8192


def _score(key: str, shard: int, weight: float, equal: bool) -> Column:
    draw = F.xxhash64(F.col(key), F.lit(shard))
    if equal:
        return draw
    unit = (F.shiftrightunsigned(draw, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return F.lit(float(weight)) / -F.log(unit)


def rendezvous(key: str, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins ``key``: highest score, then smallest shard.

    A shard's score depends on the key and that shard alone, so another shard
    takes over just the keys that it wins. With equal weights the hash itself
    is the score; else w / -ln(u) makes shares proportional to the weights.
    Null keys are hashed as the seed alone: they share one shard.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    equal = len(set(weights)) == 1
    scores = [_score(key, i, w, equal) for i, w in enumerate(weights)]
    if len(scores) == 1:
        return F.lit(0)
    top = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == top, F.lit(i)).otherwise(out)
    return out


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size is UTF-8 bytes plus 1 (null text: 1, its CRC that of no bytes); law is
    ``key``: id and weights alone decide the shard; grown_shard is the shard
    with one more of ``grown_weight``. slot numbers a shard's rows without gaps
    from 0, by cell of the id's hash, then id, size and CRC (null ids first).
    Rows that agree in all these are interchangeable and take consecutive
    slots. Other columns are ignored; an empty table gives no rows.

    Equal records are counted before anything moves and expanded only after
    numbering, so a key with a third of all rows is one row in the shuffle; a
    shard is numbered in cells, each shifted by the total of those before.
    """
    text = text_or_empty("text")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = base.select("id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    cells = max(1, math.ceil(docs.count() / (CELL_ROWS * len(weights))))
    distinct = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    distinct = distinct.withColumn("shard", rendezvous("id", weights)).withColumn("cell", F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(cells)))
    totals = distinct.groupBy("shard", "cell").agg(F.sum("n").alias("rows"))
    before = "coalesce(sum(rows) over (partition by shard order by cell rows between unbounded preceding and 1 preceding), 0)"
    offsets = totals.select("shard", "cell", F.expr(before).alias("base"))
    upto = "sum(n) over (partition by shard, cell order by id, size, crc rows between unbounded preceding and current row) - n"
    numbered = distinct.withColumn("first", F.expr(upto)).join(offsets, ["shard", "cell"])
    numbered = numbered.withColumn("grown", rendezvous("id", [*weights, grown_weight]))
    start = F.col("base") + F.col("first")
    out = numbered.select("*", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"))


def op6_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
