"""SimHash near-duplicates: fingerprints, one-wildcard segment variants, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, small, table
from .components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Members of one index bucket that a block of the pairwise check holds; larger buckets are dealt in pairs of blocks.
BLOCK = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text: bit set if set in more than half the shingle hashes.

    Bytes A-Z are lower-cased, words are runs of bytes outside the six ASCII
    white-space characters; fewer words than a shingle make one shingle of
    all, no words (or null) give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return int(sum(1 << int(b) for b in bits))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "print", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, fp) of every row; print is a hash of the text, fp the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean("simhash", _fingerprints), f"id {kind}, print bigint, fp bigint")


def schemes(distinct: int) -> tuple[int, int]:
    """(segments, segments in a key) for so many fingerprints.

    Four differing bits leave one of three segments with one of them at most;
    of m > 4 segments m - 4 stay clean at least and the best of the others has
    one, so some m - 3 together differ by one bit at most. More segments make
    longer keys, which fit more fingerprints, but more variants of each.
    """
    for m in (3, 5, 6):
        if m == 3 and distinct <= 1 << 23 or m == 5 and distinct <= 1 << 30:
            return m, max(1, m - MAX_BITS + 1)
    return 6, 3


def key_masks(segments: int, chosen: int) -> list[tuple[int, int]]:
    """(table, mask) of every one-wildcard variant: the bits of a choice of segments but for one."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    bits = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    out = []
    for pick in combinations(range(segments), chosen):
        own = [b for s in pick for b in bits[s]]
        out += [sum(1 << b for b in own if b != wild) for wild in own]
    return list(enumerate(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ b).view(np.uint16).reshape(-1, 4)
    return _POPCOUNT[x].sum(axis=1, dtype=np.uint8)


class _Forest:
    """Union-find over positions, fed with arrays of links; keeps spanning links alone."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u):
            a, b = label[u], label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _group_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one bucket that differ by ``max_bits`` or fewer bits."""
    n = len(fp)
    forest = _Forest(n)
    step = max(1, (1 << 20) // n)
    for i in range(0, n, step):
        rows = fp[i : i + step]
        x = (rows[:, None] ^ fp[None, :]).reshape(-1)
        near = (_POPCOUNT[x.view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.uint8) <= max_bits).reshape(len(rows), n)
        u, v = np.nonzero(near)
        u = u + i
        up = u < v
        forest.add(u[up], v[up])
    child = np.flatnonzero(forest.label != np.arange(n))
    return fp[child], fp[forest.label[child]]


def _bucket_links(max_bits: int):
    """mapInArrow function over rows (key, fp) sorted by key: spanning links (a, b) of each bucket."""

    def links(keys: np.ndarray, fps: np.ndarray) -> tuple[list, list]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        sizes = ends - starts
        out_a, out_b = [], []
        for size in (2, 3, 4, 5, 6, 7, 8):
            at = starts[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    a, b = fps[at + i], fps[at + j]
                    near = _distance(a, b) <= max_bits
                    out_a.append(a[near])
                    out_b.append(b[near])
        for s, e in zip(starts[sizes > 8], ends[sizes > 8]):
            a, b = _group_links(fps[s:e], max_bits)
            out_a.append(a)
            out_b.append(b)
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(k: np.ndarray, f: np.ndarray):
            a, b = links(k, f)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], ["a", "b"])
            return None

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            held.append((k, f))
            if k[0] == k[-1] and held[0][0][0] == k[0]:
                continue
            keep_k, keep_f = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            cut = int(np.flatnonzero(keep_k != keep_k[-1])[-1]) + 1
            out = flush(keep_k[:cut], keep_f[:cut])
            held = [(keep_k[cut:], keep_f[cut:])]
            if out is not None:
                yield out
        if held:
            out = flush(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            if out is not None:
                yield out

    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, scheme: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the graph of distinct fingerprints at ``max_bits`` or fewer differing bits.

    ``prints`` has one row (fp) for each distinct fingerprint, staged. Every
    one is indexed under its one-wildcard variants; those in a bucket are
    compared pair by pair, but a bucket gives the links of a spanning forest
    only, so that a group of near copies never becomes all its pairs. Buckets
    above ``block`` members are dealt to tasks as pairs of blocks.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the key schemes hold for {MAX_BITS} differing bits or fewer")
    scheme = scheme or schemes(prints.count())
    masks = key_masks(*scheme)
    variants = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in masks])
    keys = prints.select("fp", F.explode(variants).alias("x"))
    keys = keys.select(F.xxhash64("x.t", F.expr("fp & x.m")).alias("key"), "fp")
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    full = Workspace(prints.sparkSession, "simhash_buckets").stage(full, "full")
    if not full.isEmpty():
        blocks = F.ceil(F.col("n") / block).cast("int")
        dealt = keys.join(full, "key", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        own = F.pmod(F.hash("fp"), F.col("blocks"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))))
        keys = dealt.select("key", "fp", pair.alias("p")).select(F.xxhash64("key", "p.i", "p.j").alias("key"), "fp")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(lean("simhash", _bucket_links(max_bits)), "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int = MAX_BITS, scheme: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(id, print, fp, component_id) of every row."""
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.stage(with_fingerprints(docs, id_col, text_col), "rows")
    classes = work.stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    groups = components(near_links(classes.select("fp"), max_bits, scheme, block), "simhash_components")
    groups = groups.select(F.col("node").alias("fp"), "component")
    labelled = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select("id", "print", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, scheme: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links between fingerprints
    that differ by ``max_bits`` or fewer bits (null ids count only where a
    group has no other). Null, empty and blank texts have fingerprint zero and
    are linked like any other; repeated rows each get a row. Other columns are
    ignored; an empty table gives no rows.
    """
    out = _grouped(docs, id_col, text_col, max_bits, scheme, block)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose group has a smaller id: one document of each group stays.

    Rows that share the id that stays are one document and all stay; rows
    without an id stay where their group has none at all. Rows are told apart
    by id and text, so a repeated id with another text has a group of its own.
    """
    work = Workspace(docs.sparkSession, "simhash_dedup")
    rows = _grouped(docs, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("component_id")))
    gone = work.stage(rows.select(F.col("id").alias("_gone"), F.col("print").alias("_print")).distinct(), "gone")
    return docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(F.col(text_col)) == F.col("_print")), "left_anti")


def op8_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
