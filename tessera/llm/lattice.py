"""Near-duplicate embeddings: random projections decoded to E8 lattice points, verified by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .components import components

COSINE = 0.95
#: Share of pairs at exactly the threshold that the tables are to find; closer pairs are found more surely.
RECALL = 0.998
PROBES = 8
SEED = 8
#: Stored members of one cell that a task holds; larger cells are dealt to tasks in blocks.
BLOCK = 4096
#: Candidate pairs that are expanded at once.
CHUNK = 1 << 21
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or eight halves with an even number of signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd, round the worst coordinate the other way."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _probe_cells(x: np.ndarray, own: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` lattice neighbours of ``own`` nearest to each x: (rows, probes, 8)."""
    score = (x - own) @ NEIGHBOURS.T
    top = np.argpartition(-score, probes, axis=1)[:, :probes]
    return own[:, None, :] + NEIGHBOURS[top]


@dataclass(frozen=True)
class Design:
    """Projections of all tables and of the sketch, for vectors of one length."""

    projections: np.ndarray  # tables x length x 8
    planes: np.ndarray  # length x 64
    probes: int
    sketch_bits: int


def design(length: int, vectors: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, seed: int = SEED) -> Design:
    """Tables for so many vectors.

    Coarser cells hold more unrelated vectors, finer ones need more tables: the
    scale follows the number of vectors slowly. How often a pair at the
    threshold meets in one table is then measured on pairs of that angle, and
    as many tables are taken as ``recall`` asks for.
    """
    scale = min(2.0, 1.2 * max(1.0, vectors / 50_000) ** (1 / 16))
    rng = np.random.default_rng(seed)
    one = rng.normal(size=(3000, length))
    one /= np.linalg.norm(one, axis=1)[:, None]
    off = rng.normal(size=(3000, length))
    if length > 1:
        off -= (off * one).sum(axis=1)[:, None] * one
        off /= np.linalg.norm(off, axis=1)[:, None]
        two = cosine * one + math.sqrt(1 - cosine**2) * off
    else:
        two = one
    trial = rng.normal(size=(length, 8)) * scale
    met = np.zeros(3000, bool)
    for a, b in ((one, two), (two, one)):
        x, y = a @ trial, b @ trial
        own, other = nearest_e8(x), nearest_e8(y)
        cells = np.concatenate([own[:, None, :], _probe_cells(x, own, probes)], axis=1)
        met |= (cells == other[:, None, :]).all(axis=2).any(axis=1)
    tables = max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(0.98, met.mean()))))
    bit = math.acos(cosine) / math.pi
    sketch = min(64, math.ceil(64 * bit + 6.5 * math.sqrt(64 * bit * (1 - bit))))
    return Design(rng.normal(size=(tables, length, 8)) * scale, rng.normal(size=(length, 64)), probes, sketch)


def _hash_cells(cells: np.ndarray, table_no: int) -> np.ndarray:
    """64-bit keys of lattice points (doubled to integers); a clash only adds a candidate."""
    mixed = np.full(cells.shape[:-1], np.uint64(table_no * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    twice = np.rint(2 * cells).astype(np.int64).view(np.uint64)
    for i in range(8):
        mixed ^= twice[..., i] + np.uint64(0x9E3779B97F4A7C15) + (mixed << np.uint64(6)) + (mixed >> np.uint64(2))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _cells(plan: Design, length: int):
    """mapInArrow function (c, embedding) -> (key, c, sketch, stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                c = batch.column(0).to_numpy(zero_copy_only=False)
                x = _matrix(batch.column(1), length)
                x /= np.linalg.norm(x, axis=1)[:, None]
                sketch = np.packbits(x @ plan.planes > 0, axis=1).view(np.int64).reshape(-1)
                for t, projection in enumerate(plan.projections):
                    p = x @ projection
                    own = nearest_e8(p)
                    near = _hash_cells(np.concatenate([own[:, None, :], _probe_cells(p, own, plan.probes)], axis=1), t)
                    keys = np.concatenate([near[:, 0], near.reshape(-1)])
                    each = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), near.shape[1])])
                    stored = np.arange(len(keys)) < len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (keys, c[each], sketch[each], stored)], ["key", "c", "sketch", "stored"])

    return run


def _cell_pairs(sketch_bits: int):
    """mapInArrow function over (key, c, sketch, stored) sorted by key, stored first: candidate pairs (a, b)."""

    def expand(key: np.ndarray, c: np.ndarray, sketch: np.ndarray, stored: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        held = np.add.reduceat(stored.astype(np.int64), starts)
        group = np.repeat(np.arange(len(starts)), sizes)
        asks = np.flatnonzero(~stored & (held[group] > 0))
        counts = held[group[asks]]
        run = np.cumsum(counts)
        at = 0
        while at < len(asks):
            upto = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + CHUNK)))
            n = counts[at:upto]
            left = np.repeat(asks[at:upto], n)
            right = starts[group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            at = upto
            differ = c[left] != c[right]
            left, right = left[differ], right[differ]
            bits = _POPCOUNT[(sketch[left] ^ sketch[right]).view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.uint8)
            near = bits <= sketch_bits
            a, b = c[left[near]], c[right[near]]
            if len(a):
                low, high = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((high, low))
                low, high = low[order], high[order]
                first = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held.append(now)
            if now[0][-1] == held[0][0][0]:
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            held = [[x[cut:] for x in whole]]
            yield from expand(*(x[:cut] for x in whole))
        if held:
            yield from expand(*(np.concatenate(x) for x in zip(*held)))

    return run


def _verified(cosine: float, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i), length) for i in (2, 3))
            cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(cos >= cosine))

    return run


def near_pairs(classes: DataFrame, length: int, vectors: int, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of the staged ``classes`` (c, embedding of ``length``) at ``cosine`` or more."""
    work = Workspace(classes.sparkSession, "lattice_pairs")
    plan = design(length, vectors, cosine, recall)
    cells = classes.select("c", "embedding").mapInArrow(_cells(plan, length), "key bigint, c bigint, sketch bigint, stored boolean")
    cells = work.stage(cells, "cells")
    full = work.stage(cells.where("stored").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "full")
    if not full.isEmpty():
        # A stored row goes to its block of the cell, a row that asks to all blocks.
        blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
        to = F.when(F.col("stored"), F.array(F.pmod(F.hash("c"), F.col("blocks")))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        cells = cells.join(full, "key", "left").withColumn("blocks", blocks).select("*", F.explode(to).alias("part"))
        cells = cells.select(F.xxhash64("key", "part").alias("key"), "c", "sketch", "stored")
    dealt = cells.repartition("key").sortWithinPartitions("key", F.desc("stored"))
    found = dealt.mapInArrow(_cell_pairs(plan.sketch_bits), "a bigint, b bigint").distinct()
    vector = classes.select(F.col("c").alias("v"), "embedding")
    both = found.join(vector.withColumnsRenamed({"v": "a", "embedding": "x"}), "a").join(vector.withColumnsRenamed({"v": "b", "embedding": "y"}), "b")
    return work.stage(both.select("a", "b", "x", "y").mapInArrow(_verified(cosine, length), "a bigint, b bigint"), "pairs")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link at ``cosine`` or more, computed in double precision; those of
    different lengths never do. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing: n_links 0, their own component.
    Equal vectors are one class, searched once; each still counts its copies
    as links. Rows without an id count as copies too, but a component is named
    by an id only. Other columns are ignored; an empty table gives no rows.

    Every class is stored under its nearest E8 point in several tables and asks
    in that and the nearest neighbouring cells; a 64-bit sketch sorts out
    strangers, and the cosine decides.
    """
    work = Workspace(vectors.sparkSession, "lattice")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.coalesce(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(valid, F.col("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # Numbers given by the write are read back from its files, so they stay.
    classes = work.stage(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    lengths = [(r["n"], r["m"]) for r in classes.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("m")).collect()]
    pairs = None
    for n, m in sorted(lengths):
        found = near_pairs(classes.where(F.size("embedding") == n), n, m, cosine, recall, block)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ways.join(classes.select(F.col("c").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    groups = components(pairs, "lattice_components").withColumnsRenamed({"node": "c", "component": "root"})
    marked = classes.join(degree.withColumnRenamed("a", "c"), "c", "left").join(groups, "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = work.stage(marked.join(names, "root").select("embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "marked")
    out = rows.join(marked, "embedding", "left")
    n_links = F.coalesce("n_links", F.lit(0)).cast("long")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op4_lattice(spark, sf_dir):
    return embedding_groups(table(spark, sf_dir, "embeddings"))
