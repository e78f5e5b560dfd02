"""SimHash, lattice search and line dedup against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm.components import components
from tessera.llm.lattice import NEIGHBOURS, embedding_groups, nearest_e8
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.simhash import fingerprint, simhash_dedup, simhash_groups

from .cases import LONG, ODD, counted, documents, groups_of, line_drops


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "ONE two\tThree four", "a b c d a b c d a", "Straße ÄÖ ß\xa0x y z w v", "x " * 50])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def expected_components(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    distinct = sorted(set(prints))
    root = groups_of(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4])
    least = {}
    for (i, *_), p in zip(rows, prints):
        known = least.get(root[p])
        least[root[p]] = i if known is None or i is not None and i < known else known
    return Counter((i, f"{p:016x}", least[root[p]]) for (i, *_), p in zip(rows, prints))


@pytest.mark.parametrize("options", [{}, {"scheme": (5, 2), "block": 3}, {"scheme": (6, 3), "block": 7}])
def test_simhash_groups(spark, sf, options):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = "we walk along the old river and talk about the weather of the last few days before winter comes again".split()
    rows += [(10_000 + i, " ".join(base * 20 + [f"w{i}"]), None, None) for i in range(40)] + ODD
    got = counted(simhash_groups(documents(spark, rows), **options), "doc_id", "fingerprint", "component_id")
    assert got == expected_components(rows)


def test_simhash_dedup_keeps_one_of_each_group(spark):
    kept = counted(simhash_dedup(documents(spark)), "doc_id")
    expected = Counter((i,) for i, _, c in expected_components(ODD).elements() if i == c)
    assert kept == expected


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == groups_of(got, [e for e in edges if e[0] != e[1]])
    assert 5000 not in got


def test_nearest_e8_has_no_nearer_neighbour():
    x = np.random.default_rng(1).normal(size=(2000, 8)) * 3
    own = nearest_e8(x)
    d = ((x - own) ** 2).sum(axis=1)
    others = ((x[:, None, :] - (own[:, None, :] + NEIGHBOURS)) ** 2).sum(axis=2)
    assert (d <= others.min(axis=1) + 1e-9).all()
    assert len(NEIGHBOURS) == 240 and np.allclose((NEIGHBOURS**2).sum(axis=1), 2)


def brute_vectors(rows, cosine=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(np.float64)
    links = []
    at = sorted(good)
    for i in at:
        for j in at:
            if j < i and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if np.array_equal(a, b) or (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= cosine:
                    links.append((j, i))
    degree = Counter(k for pair in links for k in pair)
    root = groups_of(range(len(rows)), links)
    names = {}
    for k, (i, _) in enumerate(rows):
        known = names.get(root[k])
        names[root[k]] = i if known is None or i is not None and i < known else known
    return Counter((i, degree[k], names[root[k]], i is not None and i == names[root[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4096, 3])
def test_embedding_groups(spark, sf, block):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(400).collect()]
    rng = np.random.default_rng(3)
    for k in range(60):  # near copies of the first ones
        near = np.array(rows[k % 20][1]) + rng.normal(size=64) * np.linalg.norm(rows[k % 20][1]) * 0.02
        rows.append((90_000 + k, [float(np.float32(x)) for x in near]))
    rows += [(95_000, None), (95_001, []), (95_002, [0.0] * 64), (95_003, [1.0] * 63 + [None]), (95_004, [float("nan")] + [1.0] * 63), (95_005, [float("inf")] * 64)]
    rows += [(95_006, [1.0, 2.0]), (95_007, [2.0, 4.0]), (None, rows[0][1]), (95_008, rows[0][1]), (95_008, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<float>, c string, key string, n_links string")
    got, want = counted(embedding_groups(df, block=block), "vec_id", "n_links", "component_id", "kept"), brute_vectors(rows)
    assert sum((got & want).values()) >= 0.97 * len(rows)
    assert sum(n * c for (_, n, *_), c in got.items()) <= sum(n * c for (_, n, *_), c in want.items())
    by_id = {x[0]: x for x in got}
    for i in (95_000, 95_001, 95_002, 95_003, 95_004, 95_005):
        assert by_id[i] == (i, 0, i, True)
    assert embedding_groups(df.limit(0)).count() == 0


def removed(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_line_dedup_of_a_few_texts(spark):
    rows = [
        (1, "This line is in two documents, word for word.\nOnly here you find this one, dear reader.\nshort", None, None),
        (2, "  This line is in two documents, word for word. \nshort\nAnother line that is nowhere else to be seen.", None, None),
        (3, "This line is in two documents, word for wordy.\n\nThis line is in two documents, word for word!", None, None),
        (4, None, None, None),
        (5, "", None, None),
        (6, "日本語の長い行がここにありますので、これを比べます。\n一回だけの行です、とても珍しい。", None, None),
        (7, "日本語の長い行がここにありますので、これを比べます。", None, None),
    ]
    out = dedup_lines(documents(spark, rows, clashes=False))
    got = removed(out)
    assert got[1] == rows[0][1]
    assert got[2] == "Another line that is nowhere else to be seen."
    assert got[3] == ""
    assert (got[4], got[5]) == (None, "")
    assert got[6] == rows[5][1] and got[7] == ""
    counts = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert counts == {1: (3, 0), 2: (3, 2), 3: (3, 2), 4: (0, 0), 5: (1, 0), 6: (2, 0), 7: (1, 1)}


def test_line_dedup_against_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    gone, _ = line_drops(rows)
    want = {}
    for k, (i, text) in enumerate(rows):
        want[i] = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if (k, j) not in gone)
    got = removed(dedup_lines(documents(spark, [(i, t, None, None) for i, t in rows])))
    total = sum((t or "").count("\n") + 1 for t in want.values())
    wrong = sum(abs((got[i] or "").count("\n") - (t or "").count("\n")) for i, t in want.items() if got[i] != t)
    assert len(got) == len(rows) and wrong <= 0.002 * total
    assert sum(got[i] == t for i, t in want.items()) >= 0.97 * len(rows)


def test_line_dedup_of_odd_rows(spark):
    docs = documents(spark)
    out = dedup_lines(docs)
    assert out.columns == [*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter((i, t) for i, t, *_ in ODD)
    for i, text in ((6, ODD[5][1]), (9, LONG)):
        n = want.pop((i, text))
        want[(i, "")] = n
    want[(7, "")] = want.pop((7, ODD[7][1]))  # near row 5
    assert got == want
    assert dedup_lines(documents(spark, [])).count() == 0


def test_line_dedup_of_a_short_near_line(spark):
    got = removed(dedup_lines(documents(spark, [ODD[4], ODD[7]], clashes=False)))
    assert got == {5: ODD[4][1], 7: ""}
