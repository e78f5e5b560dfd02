"""Rows that every corpus operator must stand, and helpers of the brute-force versions."""

from __future__ import annotations

from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
LONG = "a rather long text with many words and no end in sight " * 6000
#: (doc_id, text, lang, source): nulls, empty, blank, letterless, ties, repeated rows, very long.
ODD = [
    (1, None, None, None),
    (2, "", "en", "web"),
    (3, " \t\r\n", "en", "web"),
    (4, "1234 !!! 5678", None, "web"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank", "en", "books"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", None),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", None),
    (7, "the quick  brown fox jumps over the lazy dog near the river bank ", "en", "books"),
    (8, LONG, "en", "long"),
    (9, LONG, "en", "long"),
    (None, "A text without an id that nobody can name in any way", None, "web"),
    (None, None, None, None),
]
#: Names that the operators use inside; as columns of the input they must not matter.
CLASHES = (
    "id key norm h n u v a b c n_chars size shard slot law row rest bits prefix times taken target total kept keep_id group_size text_sha256 "
    "component_id component node fingerprint fp n_links embedding_2 dropped print n_lines lang_pred score margin rejected held_out token_ids n_tokens "
    "severity grade toxic blocks cell copies uid root line at label rank draw share"
).split()


def documents(spark, rows=None, clashes: bool = True):
    """``rows`` as documents, with a text column under every clashing name."""
    extra = CLASHES if clashes else []
    schema = "doc_id bigint, text string, lang string, source string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in (ODD if rows is None else rows)], schema)


def counted(df, *columns: str) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def groups_of(nodes, links) -> dict:
    """Node to the least node of its component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(line: str, n: int = 5) -> frozenset[str]:
    return frozenset(line[i : i + n] for i in range(len(line) - n + 1))


def similar_lines(lines, least: float = 0.8) -> list[tuple[str, str]]:
    """Pairs of different lines whose 5-shingles have a Jaccard similarity of ``least`` or more."""
    sets = {x: shingles(x) for x in lines}
    holders = defaultdict(list)
    for x, s in sets.items():
        for g in s:
            holders[g].append(x)
    out = []
    for x, s in sets.items():
        shared = Counter(y for g in s for y in holders[g] if y < x)
        out += [(y, x) for y, n in shared.items() if n >= least * (len(s) + len(sets[y]) - n)]
    return out


def line_drops(docs, min_chars: int = 1):
    """For rows (id, text): the set of (id, text, line number) that go, and the component of every line."""
    at = []
    for k, (i, text) in enumerate(docs):
        for j, raw in enumerate((text or "").split("\n")):
            line = raw.strip(SPACES)
            if len(line) >= min_chars:
                at.append(((1 << 63) - 1 if i is None else i, k, j, line))
    lines = {x[3] for x in at}
    root = groups_of(lines, similar_lines(lines))
    found = defaultdict(list)
    for x in at:
        found[root[x[3]]].append(x)
    gone = set()
    for group in found.values():
        owner = min(group)[0]
        first = min(x[2] for x in group if x[0] == owner)
        gone |= {(x[1], x[2]) for x in group if not (x[0] == owner and x[2] == first)}
    return gone, root
