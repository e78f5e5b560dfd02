"""Exact dedup and sharding against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import build_directory, exact_dedup
from tessera.llm.sharding import rendezvous, shard_documents

from .cases import ODD, SPACES, counted, documents

STRIP = str.maketrans("", "", SPACES)


def expected_groups(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(STRIP)].append((i, text or ""))
    out = []
    for norm, found in groups.items():
        keep = min(found, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep[0], len(found), len(found) == 1 or (i == keep[0] and len(t) == len(keep[1])), sha) for i, t in found]
    return out


@pytest.mark.parametrize("weak", [{}, {"key_bits": 3, "digest_chars": 2, "capacity": 2}, {"key_bits": 2, "digest_chars": 0}])
def test_groups_are_those_of_equal_normalised_texts(spark, weak):
    rows = [*ODD, *[(100 + i, f"text {i % 40}" + " " * (i % 3), None, None) for i in range(200)]]
    got = counted(exact_dedup(documents(spark, rows), **weak), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == __import__("collections").Counter(expected_groups(rows))


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    slots = build_directory(keys, capacity=100).collect()
    assert {r["slot"] for r in slots} == set(range(1 << slots[0]["depth"]))
    assert sum({r["bucket"]: r["keys"] for r in slots}.values()) == 4000
    assert max(r["keys"] for r in slots) <= 100
    assert min(r["local_depth"] for r in slots) < slots[0]["depth"]


def test_the_directory_decides_which_texts_meet(spark):
    """A directory that sends a key to two owners splits its group; copies of the rows of one owner alone are not enough."""
    rows = [(i, f"text {i % 50}", None, None) for i in range(200)]
    docs = documents(spark, rows, clashes=False)
    right = {r["doc_id"]: r["group_size"] for r in exact_dedup(docs, capacity=4).collect()}
    assert set(right.values()) == {4}
    slots = [(0, 0, 3), (1, 1, 3), (2, 2, 3), (2, 99, 3), (3, 3, 3), (4, 4, 3), (5, 5, 3), (6, 6, 3)]  # slot 2 twice, slot 7 in no bucket
    wrong = spark.createDataFrame([(s, b, 3, 0, d) for s, b, d in slots], "slot long, bucket long, local_depth int, keys long, depth int")
    got = [(r["doc_id"], r["group_size"]) for r in exact_dedup(docs, directory=wrong).collect()]
    assert len(got) > len(rows) and 1 in {n for _, n in got}


def test_empty_table(spark):
    none = documents(spark, [])
    assert exact_dedup(none).count() == 0
    assert shard_documents(none).count() == 0


def test_slots_are_gapless_and_the_key_decides(spark):
    rows = [*ODD, *[(i, f"t{i}", None, None) for i in range(1000, 4000)], *[(77, "same", None, None)] * 1500]
    out = shard_documents(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert (out.groupby(out["doc_id"].fillna(-1))["shard"].nunique() == 1).all()
    moved = out[out["grown_shard"] != out["shard"]]
    assert set(moved["grown_shard"]) <= {8}
    spread = out[out["doc_id"] >= 1000]
    assert 0.08 < (spread["grown_shard"] == 8).mean() < 0.15
    assert spread["shard"].value_counts().min() > 280
    texts = {i: t for i, t, *_ in rows if i is not None}
    for i, size, crc in zip(out["doc_id"], out["size"], out["text_crc32"]):
        if i == i:
            raw = (texts[int(i)] or "").encode()
            assert (size, crc) == (len(raw) + 1, zlib.crc32(raw))


def test_weights_set_the_shares(spark):
    counts = dict(spark.range(20000).groupBy(rendezvous("id", [1.0, 3.0]).alias("s")).count().collect())
    assert 0.73 < counts[1] / 20000 < 0.77
    before = spark.range(5000).select("id", rendezvous("id", [1.0, 3.0]).alias("s"), rendezvous("id", [1.0, 3.0, 2.0]).alias("t"))
    assert before.where("s != t and t != 2").count() == 0
    with pytest.raises(ValueError):
        rendezvous("id", [1.0, 0.0])
