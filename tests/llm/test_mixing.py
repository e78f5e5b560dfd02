"""Mixing to target weights against a loop that shares the budget out."""

import re
from collections import defaultdict

import pytest

from tessera.llm.mixing import mix, mixed_documents

from .cases import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loop_targets(totals, weights=(3, 1, 2), budget=1.5, cap=2):
    """Shares by weight again and again, sources above their cap held at it."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, held = budget * sum(totals.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        level = (left - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * totals[s]]
        if not over:
            return held | {s: level * weight[s] for s in free}
        held |= {s: float(cap * totals[s]) for s in over}


@pytest.fixture(scope="module")
def rows():
    out = [*ODD, (20, "", None, "blank"), (21, None, None, "blank")]
    for i in range(4000):
        source = ["hot", "hot", "hot", "b", "c", "d", None][i % 7]
        out.append((1000 + i, "word " * (1 + (i * 7919) % 97), None, source))
    return out


def test_sizes_targets_and_taken(spark, rows):
    got = mix(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    totals, most = defaultdict(int), defaultdict(int)
    for _, text, _, source in rows:
        n = len(WORD.findall(text or ""))
        totals[source] += n
        most[source] = max(most[source], n)
    target = loop_targets(totals)
    source_of = {i: s for i, _, _, s in rows if i is not None and i >= 1000}
    taken = defaultdict(int)
    for r in got.itertuples():
        assert 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        if r.doc_id == r.doc_id and r.doc_id >= 1000:
            source = source_of[int(r.doc_id)]
            assert r.source_size == totals[source]
            assert r.target == pytest.approx(target[source], rel=1e-9)
            taken[source] += r.taken
    for source in ("hot", "b", "c", "d"):
        assert abs(taken[source] - target[source]) <= 0.01 * target[source] + most[source]
    again = mix(documents(spark, rows[::-1], clashes=False)).toPandas()
    key = ["doc_id", "size", "source_size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()


def test_the_mix_itself_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 5), None, "abc"[i % 3]) for i in range(300)]
    docs = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    counts = dict(out.groupBy("doc_id").count().collect())
    assert counts == {i: n for i, n in taken.items() if n}


def test_ties_are_taken_in_part(spark):
    """3,000 equal rows, and rows without an id: a part of a tie is taken, so that targets are met."""
    rows = [(7, "five words are in here", None, "a")] * 3000 + [(None, "w " * (1 + i % 3), None, "b") for i in range(3000)] + [(i, "x y z", None, "c") for i in range(10_000, 14_000)]
    docs = documents(spark, rows, clashes=False)
    got = mix(docs).collect()
    taken, total = defaultdict(int), defaultdict(int)
    source = lambda r: "a" if r["doc_id"] == 7 else "b" if r["doc_id"] is None else "c"
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[source(r)] += r["taken"]
        total[source(r)] += r["size"]
    for name, target in loop_targets(total).items():
        assert abs(taken[name] - target) <= 0.01 * target
    out = defaultdict(int)
    for r in mixed_documents(docs).collect():
        out[source(r)] += len(WORD.findall(r["text"]))
    assert out == taken


def test_empty_table(spark):
    assert mix(documents(spark, [])).count() == 0
