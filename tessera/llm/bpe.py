"""Byte-level BPE by replaying merges over the pieces of many texts at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: Words whose ids a task remembers; beyond that it forgets them all and starts anew.
CACHE_WORDS = 500_000
#: New words that one replay of the merges takes.
BATCH_WORDS = 200_000
#: Unicode white space, spelled out: regex's own \s also takes the ASCII separators 1C-1F.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Cuts where the public pattern always cuts: it joins one space at most to what follows, and nothing else across white space.
WORDS = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def public_pattern() -> str:
    """The split pattern of the public 50k vocabularies."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


def splitter(pattern: str) -> regex.Pattern:
    spelled = pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]")
    return regex.compile(spelled)


class Merges:
    """The merges of a rank file: which pairs of token ids join, and into what."""

    #: Ranks that share a bucket of the inverted index, as a power of two.
    BUCKET = 9

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.base = max(ranks.values()) + 2
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.none = np.int32(self.base + (1 << self.BUCKET))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``none``."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], self.none)


def merge_pieces(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, how many each has), all merges applied in rank order.

    The bytes of all pieces lie in linked slots. An inverted index leads from
    pairs to the slots where they stand, in buckets of neighbouring ranks; the
    lowest bucket is taken first, and from it, for every piece at once, its
    lowest pair, the leftmost of equals. A merge writes its slot and looks up
    the pairs with its two neighbours only, which enter the index anew, in a
    lower bucket too if that is their rank. Each piece thus sees its merges in
    the order in which it would apply them alone.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(lengths.sum())
    token = np.append(merges.bytes[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(merges.base - 1))
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    ends = np.cumsum(lengths)
    filled = lengths > 0
    # The slot n is beyond every piece: its token joins with nothing.
    after[ends[filled] - 1] = n
    after[n:] = n
    before[(ends - lengths)[filled]] = n
    alive = np.ones(n + 1, bool)
    rank = np.append(merges.rank(token[:-1], token[after[:-1]]), merges.none) if n else np.array([merges.none])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(slots: np.ndarray) -> None:
        slots = slots[rank[slots] != merges.none]
        if not len(slots):
            return
        bucket = (rank[slots] >> merges.BUCKET).astype(np.int16)
        order = np.argsort(bucket, kind="stable")
        slots, bucket = slots[order], bucket[order]
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for b, part in zip(bucket[np.concatenate([[0], cuts])].tolist(), np.split(slots, cuts)):
            if b not in index:
                index[b] = []
                heapq.heappush(heap, b)
            index[b].append(part)

    enter(np.arange(n, dtype=np.int32))
    while heap:
        b = heapq.heappop(heap)
        slots = np.sort(np.concatenate(index.pop(b)))
        slots = slots[np.concatenate([[True], slots[1:] != slots[:-1]]) & ((rank[slots] >> merges.BUCKET) == b)]
        if not len(slots):
            continue
        own, r = owner[slots], rank[slots]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        least = np.repeat(np.minimum.reduceat(r, starts), np.diff(np.append(starts, len(slots))))
        chosen = np.flatnonzero(r == least)
        chosen = chosen[np.concatenate([[True], own[chosen[1:]] != own[chosen[:-1]]])]
        rest = np.ones(len(slots), bool)
        rest[chosen] = False
        at = slots[chosen]
        right = after[at]
        beyond, left = after[right], before[at]
        token[at] = r[chosen]
        alive[right] = False
        rank[right] = merges.none
        after[at] = beyond
        before[beyond] = at
        rank[at] = merges.rank(token[at], token[beyond])
        rank[left] = merges.rank(token[left], token[at])
        rank[n] = merges.none
        enter(np.concatenate([slots[rest], at, left]))
    kept = alive[:n]
    return token[:n][kept], np.bincount(owner[kept], minlength=len(pieces))


class Codec:
    """Encodes and decodes lists of texts; remembers the pieces it has seen, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS) -> None:
        self.ranks, self.merges, self.split, self.bound = ranks, Merges(ranks), splitter(pattern).findall, cache_words
        self.words = re.compile(WORDS).findall if pattern == public_pattern() else self.split
        self.tokens = {rank: token for token, rank in sorted(ranks.items(), key=lambda x: x[1])}
        self.seen: dict[str, bytes] = {}  # ids as int32, one after another

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > self.bound:
            self.seen = {}
            new = words
        new = list(new)
        for i in range(0, len(new), BATCH_WORDS):
            part = new[i : i + BATCH_WORDS]
            # A word of letters alone is one piece.
            cut = [[w] if w.isalpha() or w[:1] == " " and w[1:].isalpha() else self.split(w) for w in part]
            pieces = list(set(chain.from_iterable(cut)))
            raw = [p.encode("utf-8") for p in pieces]
            whole = [self.ranks.get(x) for x in raw]
            flat, counts = merge_pieces([x for x, r in zip(raw, whole) if r is None], self.merges)
            packed, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            merged = (packed[a:b] for a, b in zip([0, *ends], ends))
            ids = {p: next(merged) if r is None else r.to_bytes(4, "little") for p, r in zip(pieces, whole)}
            self.seen.update((w, ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))) for w, c in zip(part, cut))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as int32; null texts have none."""
        cut = [self.words(t or "") for t in texts]
        self._learn(set(chain.from_iterable(cut)))
        seen = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(seen, words)), "<i4") for words in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; any ids of the vocabulary can be decoded, also where the bytes are no UTF-8."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def _codec(lines: bytes, pattern: str) -> Codec:
    return Codec(parse_ranks(lines), pattern)


def _vocabulary(spark: SparkSession, path: str):
    """The rank file as a broadcast (below a megabyte for 50k tokens), read by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _portions(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded total length (one text at least), so that pieces in memory are bounded."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every row's whole text; null and empty texts have no ids.

    Every match of ``pattern`` is merged apart, special tokens are ordinary
    text. A scan and one Arrow stage: nothing is shuffled, and a lost executor
    costs its own partitions. Other columns are ignored; repeated rows each
    get a row.
    """
    ranks = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for at, texts in _portions(batch.column(1).to_pylist()):
                ids = codec.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), arrays], ["id", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean("bpe", run, _codec.cache_clear), f"id {kind}, token_ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_tokens(rows: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, bytes binary) from token ids; null ids decode to no bytes. An id outside the vocabulary is an error."""
    ranks = _vocabulary(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            found = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(lean("bpe", run, _codec.cache_clear), f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what encoding and decoding of each row give."""
    ranks = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        decimal = {i: str(i) for i in codec.tokens}.__getitem__
        for batch in batches:
            for at, texts in _portions(batch.column(1).to_pylist()):
                lengths, ids_sha, bytes_sha = [], [], []
                for ids in map(np.ndarray.tolist, codec.encode(texts)):
                    lengths.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    bytes_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                columns = [batch.column(0).slice(at, len(texts)), pa.array(lengths, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean("bpe", run, _codec.cache_clear), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
