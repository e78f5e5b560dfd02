"""The corpus pipeline and each of its stages against brute force, on the smallest table and short clean documents."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.bpe import _portions, parse_ranks
from tessera.llm.language_id import MIN_MARGIN, classify, train_model
from tessera.llm.mixing import mix

from .cases import documents, line_drops
from .test_mixing import WORD, loop_targets
from .test_near_duplicates import expected_components

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The table documents with short clean ones: the first 3, 6, 12 and 18 words of lines of clean documents."""
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*NAMES)
    clean = [r for r in docs.where("lang is not null").orderBy("doc_id").collect() if r["text"] and len(r["text"].split()) > 60]
    short = [" ".join(r["text"].split()[20 : 20 + n]) for k, r in enumerate(clean[:80]) for n in ((3, 6, 12, 18)[k % 4],)]
    rows = [(500_000 + k, t, clean[k]["lang"], clean[k]["source"], len(t)) for k, t in enumerate(short)]
    rows += [(600_000, None, None, None, None), (600_001, "", None, "web", 0), (600_002, "1234 !!! 5678", None, "web", 13)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{top}/documents.parquet")
    return str(top)


def rows_of(df):
    return [tuple(r[c] for c in NAMES) for r in df.select(*NAMES).collect()]


def plain_language(rows, model):
    frozen = tuple(sorted(model.items()))
    found = [(r, classify(r[1], frozen)) for r in rows]
    return [r for r, (lang, _, margin) in found if lang != "und" and margin >= MIN_MARGIN]


def plain_lines(rows):
    gone, _ = line_drops([r[:2] for r in rows])
    out = []
    for k, r in enumerate(rows):
        text = None if r[1] is None else "\n".join(x for j, x in enumerate(r[1].split("\n")) if (k, j) not in gone)
        out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def plain_near(rows):
    kept = {i for i, _, c in expected_components([r[:4] for r in rows]) if i == c}
    return [r for r in rows if r[0] in kept]


def plain_tokens(rows):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    return Counter((r[0], tuple(coder.encode_ordinary(r[1] or ""))) for r in rows)


def tokens_of(df):
    rows = df.collect()
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
    return Counter((r["doc_id"], tuple(r["token_ids"])) for r in rows)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = rows_of(docs)
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5 and len({r[0] for r in rows}) == len(rows)
    frame = lambda found: spark.createDataFrame(found, docs.schema)

    kept = plain_language(rows, train_model(docs))
    assert Counter(rows_of(stages[0](spark, docs, folder))) == Counter(kept)
    ids = {r[0] for r in kept}
    assert not ids & {600_000, 600_001, 600_002}
    for low, high in ((1, 5), (5, 10), (10, 20), (20, 1 << 30)):
        clean = [r[0] for r in rows if r[2] is not None and low <= len(WORD.findall(r[1] or "")) < high]
        print(f"language stage, with a language and {low} words or more, under {high}: {sum(i not in ids for i in clean)} of {len(clean)} rejected")

    lines = plain_lines(kept)
    assert Counter(rows_of(stages[1](spark, frame(kept), folder))) == Counter(lines)
    near = plain_near(lines)
    assert Counter(rows_of(stages[2](spark, frame(lines), folder))) == Counter(near)

    mixed = rows_of(stages[3](spark, frame(near), folder))
    times = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mix(frame(near)).collect()}
    by_id = {r[0]: r for r in near}
    # Rows without words weigh nothing in any mix; how often they are taken is left open.
    assert Counter(r for r in mixed if WORD.search(r[1] or "")) == Counter({by_id[i]: n for i, n in times.items() if n})
    totals, most, taken = Counter(), Counter(), Counter()
    for r in near:
        n = len(WORD.findall(r[1] or ""))
        totals[r[3]] += n
        most[r[3]] = max(most[r[3]], n)
        taken[r[3]] += n * times[r[0]]
    for source, target in loop_targets(totals).items():
        assert abs(taken[source] - target) <= 0.01 * target + 2 * most[source]

    want = plain_tokens(mixed)
    assert tokens_of(stages[4](spark, frame(mixed), folder)) == want
    assert tokens_of(corpus_pipeline.run(spark, folder)) == want
    print("rows after each stage:", len(rows), len(kept), len(lines), len(near), len(mixed), sum(want.values()))


def test_stages_keep_columns_of_any_name(spark, folder):
    """Nulls, repeats, long texts and columns named like the operators' own: what a stage returns is as it came."""
    learnt = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang", "source").limit(150)
    odd = documents(spark)
    extra = [c for c in odd.columns if c not in learnt.columns]
    docs = odd.unionByName(learnt.select("*", *[F.lit("clash").alias(c) for c in extra]))
    docs = docs.withColumn("score", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("!")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        changed = {"n_chars"} if name == "line dedup" else set()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.collect():
            assert r["score"] == ("none!" if r["doc_id"] is None else f"{r['doc_id']}!"), name
            assert {r[c] for c in extra if c not in changed | {"score"}} <= {"clash"}, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.tokenise(spark, docs.limit(0), folder).count() == 0


def test_stages_leave_no_model_in_the_workers(spark, folder):
    """A worker that has encoded forgets the codec when it tells languages, and the compressors when it encodes again."""

    def held(batches):
        import pyarrow as pa

        from tessera.llm import bpe, language_id

        list(batches)
        yield pa.RecordBatch.from_pydict({"codecs": [bpe._codec.cache_info().currsize], "compressors": [language_id._compressors.cache_info().currsize]})

    def most():
        rows = spark.range(0, 16, 1, 16).mapInArrow(held, "codecs long, compressors long").collect()
        return max(r["codecs"] for r in rows), max(r["compressors"] for r in rows)

    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(16)
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    # Idle workers are taken at random, so each stage has tasks enough to reach all of them.
    drain(corpus_pipeline.tokenise(spark, docs, folder))
    assert most()[0] == 1
    drain(corpus_pipeline.language_id(spark, docs, folder))
    assert most() == (0, 1)


def test_bpe_takes_texts_in_small_portions():
    """Words of a portion are in memory at once, as is what becomes of them; a long text stays whole."""
    texts = ["word " * 1000] * 2000 + [None, "", "word " * 800_000, "end"]
    parts = list(_portions(texts))
    assert [t for _, part in parts for t in part] == texts
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    assert all(sum(len(t or "") for t in part) <= 2_000_000 or len(part) == 1 for _, part in parts)
