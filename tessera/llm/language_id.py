"""Language identification by compression with one zstandard dictionary for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, small, table

#: Bounds of the training sample: documents, and bytes of a dictionary, for each language.
SAMPLE_ROWS = 400
DICT_BYTES = 48 << 10
#: A long text is compressed in parts of so many bytes, all of them, so that the dictionary stays in reach.
PART_BYTES = 2048
#: Short matches matter more than long ones here, so the search is set by hand.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 4}
#: Characters of the windows that decide where all dictionaries give the same size, as happens with a few words.
TIE_CHARS = 5
#: Relative gap between best and second language below which a text is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: str | Column) -> Column:
    """Documents never learnt from: crc32 of the id as text, mod 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, label: str, allowed: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of at most ``rows`` ids for each label, by a hash of the id: (label, text).

    Only labels and ids are ranked. A first pass sets, for each label, the share of
    the hash range that holds somewhat more than ``rows`` ids, and only ids in
    that share meet in a label's task, so a label with most of the table is never gathered.
    Texts are joined to the ids chosen; of rows that share an id and a label the least text counts.
    """
    known = docs.where(allowed & F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11).cast("double") / F.lit(float(1 << 53))
    limits = known.groupBy("label").agg(F.least(F.lit(1.0), F.lit(2.0 * rows + 50) / F.approx_count_distinct("id")).alias("share"))
    drawn = known.select("label", "id", draw.alias("draw")).join(F.broadcast(limits), "label").where("draw < share").select("label", "id", "draw").distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))
    chosen = drawn.withColumn("rank", rank).where(F.col("rank") <= rows).select("label", "id")
    return known.join(small(Workspace(docs.sparkSession, "language_sample").stage(chosen, "chosen")), ["label", "id"]).groupBy("label", "id").agg(F.min("text").alias("text")).select("label", "text")


def learn(docs: DataFrame, label: str = "lang", allowed: Column | None = None, rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Raw-content dictionary of each language, from the lines of sampled texts, up to ``dict_bytes``.

    Lines of whole texts enter in the order of their hash, each once and normalised, until the dictionary is full, so
    that a long text has no more say than its lines. Every language gets as
    many bytes as the one with the least text allows, but no fewer than 4 KB
    where it has them, since a longer dictionary compresses better in any
    language. The driver gets the lines that reach ``dict_bytes`` for each language and no more.
    """
    texts = sample(docs, label, F.lit(True) if allowed is None else allowed, rows, id_col, text_col)
    each = texts.select("label", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{M}]+", " "))).where("line != ''").distinct()
    upto = Window.partitionBy("label").orderBy(F.xxhash64("line"), "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("before", F.sum(F.octet_length("line") + 1).over(upto) - F.octet_length("line")).where(F.col("before") <= dict_bytes)
    lines: dict[str, dict[str, None]] = {}
    for r in each.orderBy("label", "before").select("label", F.expr(f"substring(line, 1, {dict_bytes})").alias("line")).collect():
        if line := normalise(r["line"]):
            lines.setdefault(r["label"], {})[line] = None
    joined = {lang: " ".join(found).encode("utf-8") for lang, found in lines.items()}
    if not joined:
        return {}
    room = min(dict_bytes, max(4096, min(map(len, joined.values()))))
    return {lang: text[:room] for lang, text in sorted(joined.items())}


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH)
    out = []
    for lang, text in model:
        shared = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=shared, compression_params=params)))
    return out


def normalise(text: str) -> str:
    """Letters in lower case; runs of anything else are one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """(language, score, margin) of a whole text.

    The language whose dictionary gives the fewest bytes over all parts wins.
    margin is how many bytes less the winner takes than the next, as a share of
    the next; where sizes tie, the winner has more of the text's short windows
    in its dictionary, then the first name, and margin is the difference in
    shares of windows. score maps margin to 0..1. Text without any letter is
    ``und`` with score 0.
    """
    if not text or not any(map(str.isalpha, text)) or not model:
        return UNKNOWN, 0.0, 0.0
    plain = normalise(text).encode("utf-8", "surrogatepass")
    parts = [plain[i : i + PART_BYTES] for i in range(0, len(plain), PART_BYTES)]
    sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in _compressors(model))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    best, second = sizes[0], sizes[1]
    margin = (second[0] - best[0]) / second[0]
    if not margin:
        padded = b" " + plain + b" "
        windows = {padded[i : i + TIE_CHARS] for i in range(max(1, len(padded) - TIE_CHARS + 1))}
        tied = {lang for size, lang in sizes if size == best[0]}
        shares = sorted((-sum(w in d for w in windows) / len(windows), lang) for lang, d in model if lang in tied)
        best, margin = shares[0], shares[1][0] - shares[0][0]
    return best[1], margin / (margin + 0.02), margin


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected`` (und, or a narrower margin than ``min_margin``).

    One Arrow stage, no shuffle; only the text is sent to Python with the
    row's columns carried along as they are. Columns of these four names in
    ``docs`` are replaced. Null and letterless texts are ``und``.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "margin", "rejected")]
    names = [f"c{i}" for i in range(len(kept))]
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = frozen.value
        for batch in batches:
            found = [classify(t, trained) for t in batch.column(at).to_pylist()]
            lang, score, margin = (list(x) for x in zip(*found)) if found else ([], [], [])
            rejected = [name == UNKNOWN or m < min_margin for name, m in zip(lang, margin)]
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "lang_pred", "score", "margin", "rejected"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept)) + ", lang_pred string, score double, margin double, rejected boolean"
    out = docs.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, kept)]).mapInArrow(lean("language_id", run, _compressors.cache_clear), schema)
    return out.toDF(*[f.name for f in kept], "lang_pred", "score", "margin", "rejected")


def train_model(docs: DataFrame) -> dict[str, bytes]:
    """The production model, from rows that are not held out."""
    return learn(docs, allowed=~held_out("doc_id"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")
