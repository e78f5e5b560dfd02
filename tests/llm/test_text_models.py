"""BPE against tiktoken, language ID and toxicity on held-out rows, HTML pages by hand."""

import base64
import hashlib
import math
import time
import unicodedata
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tessera.llm.bpe import Codec, decode_tokens, encode_documents, parse_ranks, public_pattern, round_trip
from tessera.llm.html_text import extract, extract_pages, op1_html_text
from tessera.llm.language_id import PART_BYTES, SEARCH, classify, held_out, identify, op9_language_id, train_model
from tessera.llm.toxicity import BUCKETS, OrdinalModel, features_of, fit_ordinal, op10_toxicity, severity, training_sample

from .cases import ODD, documents

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "a", "Hello world", "  two  spaces  ", "tab\tand\nline\r\n", "it's we'll I'd 'S", "naïve café ĳ", "日本語テキスト", "🙂🙂 🏳️‍🌈", "x" * 300, "ab" * 200, "\x1c\x1d a\x85b　c\xa0d", "<|endoftext|>", "\x00\x01", "1234567890 12,5", "áé", "שלום עולם", "​zero"]


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert public_pattern() == public_tokenizers.PATTERN


def test_codec_equals_tiktoken(reference):
    with open(VOCABULARY, "rb") as f:
        codec = Codec(parse_ranks(f.read()), public_tokenizers.PATTERN, cache_words=7)
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(chr(c) for c in rng.choice([32, 97, 98, 101, 116, 39, 115, 48, 233, 10, 0x4E2D, 0x1F600], 200)) for _ in range(200)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids.tolist()) == text.encode()


def test_documents_round_trip(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_decoding(spark, reference):
    ids = encode_documents(documents(spark), VOCABULARY, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] or 0, r["token_ids"]) for r in ids.collect())
    assert got == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t, *_ in ODD)
    back = decode_tokens(ids.unionByName(spark.createDataFrame([(99, None)], "doc_id long, token_ids array<int>")), VOCABULARY, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in back.collect()) == sorted([*((i or 0, (t or "").encode()) for i, t, *_ in ODD), (99, b"")])
    assert round_trip(documents(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in out.collect() if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(rows) > 100 and sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = [r for r in rows if len(r["text"].split()) >= 20]
    assert sum(r["rejected"] for r in kept) <= 0.02 * len(kept)


def test_language_of_odd_rows(spark, sf):
    model = train_model(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = documents(spark)
    out = identify(docs, model)
    assert out.columns[:4] == docs.columns[:4] and out.columns[-4:] == ["lang_pred", "score", "margin", "rejected"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert len(got) == len(ODD)
    assert {i for i, lang in got if lang == "und"} == {1, 2, 3, 4, None}
    assert [lang for i, lang in got if i is None].count("und") == 1
    assert identify(documents(spark, []), model).count() == 0
    assert classify("some words", ()) == ("und", 0.0, 0.0)
    assert train_model(documents(spark, [], clashes=False)) == {}
    marks = {r["doc_id"]: r["h"] for r in spark.range(40).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()}
    assert marks == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}


def test_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.01"
    out = op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    rows = [(r["truth"], r["toxic"], r["severity"]) for r in out.collect() if r["truth"] is not None]
    hits = [t for truth, t, _ in rows if truth == 1]
    clean = [t for truth, t, _ in rows if truth == 0]
    assert sum(hits) >= 0.9 * len(hits) and sum(clean) <= 0.03 * len(clean)


def test_ordinal_fit_of_three_grades():
    texts, grades = [], []
    for i in range(240):
        g = i % 3
        texts.append(f"plain words number{i % 17} " + ("awful " if g else "") + ("horrid " if g == 2 else ""))
        grades.append(g)
    model = fit_ordinal([features_of(t) for t in texts], np.array(grades))
    scores = np.array([float(model.weights[b].astype(float) @ n) for b, n in map(features_of, texts)])
    severe = model.severity(model.above(scores))
    assert model.grades == (0, 1, 2) and (np.diff(model.theta) > 0).all()
    means = [severe[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert fit_ordinal([features_of("x")], np.array([1])).grades == (1,)


def test_toxicity_of_odd_rows(spark):
    model = OrdinalModel((0, 1), np.array([1.0]), np.zeros(BUCKETS, np.float32))
    got = severity(documents(spark), model).collect()
    assert len(got) == len(ODD) and {r["toxic"] for r in got} == {False}
    assert severity(documents(spark, []), model).count() == 0
    one = severity(documents(spark), OrdinalModel((0,), np.zeros(0), np.zeros(BUCKETS, np.float32))).collect()
    assert {r["severity"] for r in one} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p { color: red }</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">Other</a></li></ul></nav><header><h1>Site</h1></header>
<div class="cookie-banner">We use cookies on this site and want you to agree to them.</div>
<article><h2>The   headline &amp; more</h2><p>First paragraph of the article with <b>bold</b> and <a href="#">a link</a>, long enough to count.</p>
<div class="advert">Buy now this wonderful thing that you never needed before today.</div>
<p>Second&nbsp;paragraph
 goes on &lt;here&gt; &#8212; with an entity and enough words to be seen.</p><ul><li>One item of a list</li><li>Another item</li></ul></article>
<aside>Related things that nobody wants to read at all in this place.</aside>
<section id="comments"><p>A reader says that this was a nice article to read.</p></section>
<form><label>Mail</label><input value="x"></form><footer>Copyright somebody, all rights reserved.</footer></body></html>"""


def test_article_text():
    assert extract(PAGE).split("\n\n") == [
        "The headline & more",
        "First paragraph of the article with bold and a link, long enough to count.",
        "Second paragraph goes on <here> — with an entity and enough words to be seen.",
        "One item of a list",
        "Another item",
    ]


TWO = "<p>The first paragraph of this page is long enough to be told from everything around it.</p><p>The second one follows it and is about as long as the first one was, or nearly.</p>"


@pytest.mark.parametrize("wrapper", [
    '<div class="has-sidebar layout">{}</div>', '<div id="page" class="no-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<article class="post related-content">{}</article>',
    '<article><p class="follow-up">{}</p></article>', '<article><section class="legal-background">{}</section></article>', '<div class="sidebar">{}</div>', '<div class="widget"><div class="header">{}</div></div>', "<div>{}</div>",
])
def test_wrappers_named_like_boilerplate_keep_the_text(wrapper):
    menu = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(9))
    got = extract(f"<html><body><ul>{menu}</ul>{wrapper.format(TWO)}<div class='ad'>Buy now.</div></body></html>").split("\n\n")
    assert [x[:10] for x in got] == ["The first ", "The second"]


def test_the_windows_decide_beside_an_article():
    far = "<div></div>" * 4
    page = f"<body><p>Log in to read more.</p>{far}<article>{TWO * 3}<div>Tags</div></article>{far}<div>Seen 12 times.</div></body>"
    assert [x[:4] for x in extract(page).split("\n\n")] == ["The "] * 6 + ["Tags"]
    # The same without marks: one window is too low to be a surge, and the line beside the text is not told from it.
    assert [x[:4] for x in extract(page.replace("article", "div")).split("\n\n")] == ["The "] * 6 + ["Tags"]
    lone = page.replace("<div>Tags</div>", f"{far}<div>Tag</div>")
    assert [x[:4] for x in extract(lone.replace("article", "div")).split("\n\n")] == ["The "] * 6


def test_deep_nesting_takes_linear_time():
    def took(n):
        began = time.perf_counter()
        extract("<div><b>" * n + "</i></section>" * n + "<p>text</p>" * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 24 * max(took(2_000), 0.01)


class _ArticleBlocks(HTMLParser):
    """Brute force for pages whose article is an element: its blocks, by the standard library's parser."""

    BLOCKS = {"p", "h1", "h2", "h3", "ul", "li", "div", "section", "blockquote", "article"}

    def __init__(self):
        super().__init__()
        self.depth, self.parts, self.blocks = 0, [], []

    def cut(self):
        self.blocks.append(" ".join("".join(self.parts).split()))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.cut() if tag in self.BLOCKS else self.parts.append(" ") if tag == "br" else None
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_whole_table_against_brute_force(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in op1_html_text(spark, "/root/testdata/sf0.01").collect():
        parser = _ArticleBlocks()
        parser.feed(rows[r["page_id"]] or "")
        parser.close()
        parser.cut()
        assert r["text"] == "\n\n".join(x for x in parser.blocks if x), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_page_without_marks():
    body = "".join(f"<p>Paragraph {i} of a long text that goes on for a good while without any markup.</p>" for i in range(8))
    menu = "".join(f"<div><a href='/{i}'>Entry {i}</a></div>" for i in range(9))
    got = extract(f"<html><body>{menu}{body}<div><a href='/'>top</a></div></body></html>").split("\n\n")
    assert len(got) == 8 and got[0].startswith("Paragraph 0")


def test_body_in_plain_blocks_beside_a_teaser_card():
    body = "".join(f"<div>Paragraph {i} of a long text that goes on for a good while without any markup.</div>" for i in range(8))
    card = "<article><h3>Teaser</h3><p>Three words more.</p></article>"
    menu = "".join(f"<div><a href='/{i}'>Entry {i}</a></div>" for i in range(9))
    for page in (menu + body + card, card + menu + body):
        got = extract(f"<html><body>{page}</body></html>").split("\n\n")
        assert [x for x in got if x.startswith("Paragraph")] == [f"Paragraph {i} of a long text that goes on for a good while without any markup." for i in range(8)]
        assert not any(x.startswith("Entry") for x in got)


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<a b='", "&#x110000; &#0; &bad", "<p>" * 3000])
def test_broken_pages(html):
    assert isinstance(extract(html), str)


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, None, "plain text only " * 30, "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert len(got) == 5 and sum(r["text"] == "" for r in got) == 2
    assert extract_pages(pages.limit(0)).count() == 0


def test_language_of_the_whole_table_against_brute_force(spark, sf):
    """Every text against every dictionary by a fresh compressor, sizes added up part by part."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train_model(docs)
    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH)
    got = {r["doc_id"]: r for r in op9_language_id(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        letters = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in (text or "").lower())
        plain = " ".join(letters.split()).encode()
        if not plain:
            assert got[doc_id]["lang_pred"] == "und" and got[doc_id]["score"] == 0
            continue
        sizes = {}
        for lang, dictionary in model.items():
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(coder.compress(plain[i : i + PART_BYTES])) for i in range(0, len(plain), PART_BYTES))
        least = min(sizes.values())
        assert sizes[got[doc_id]["lang_pred"]] == least
        second = sorted(sizes.values())[1]
        if second > least:
            assert got[doc_id]["margin"] == pytest.approx((second - least) / second)


def test_toxicity_of_the_whole_table_against_brute_force(spark, sf):
    """Every text scored by plain loops over its words, with the thresholds of the fitted model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = fit_ordinal(*training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    texts = dict(docs.collect())
    got = op10_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = set("".join(c if c.isalpha() else " " for c in (texts[r["doc_id"]] or "").lower()).split())
        raw = [x for w in words for x in [w, *("^" + w[:n] for n in range(4, 9) if len(w) >= n)]]
        score = sum(float(model.weights[zlib.crc32(x.encode()) % BUCKETS]) for x in raw)
        above = [1 / (1 + math.exp(t - score)) for t in model.theta]
        assert r["severity"] == pytest.approx(model.grades[0] + sum(p * (b - a) for p, a, b in zip(above, model.grades, model.grades[1:])), abs=1e-6)
        assert r["p_toxic"] == pytest.approx(above[0], abs=1e-6)


def test_ordinal_fit_is_a_minimum_of_its_loss():
    """No small step along a weight or a threshold lowers the penalised loss, computed anew by plain loops."""
    rng = np.random.default_rng(4)
    rows = [(np.array([0, 1, 2]), rng.integers(1, 4, 3)) for _ in range(120)]
    grades = np.array([int(np.clip(c[0] - c[1] + rng.integers(0, 2), 0, 2)) for _, c in rows])
    model, l1 = fit_ordinal(rows, grades, rounds=4000, l1=1e-3), 1e-3
    most = np.max([c for _, c in rows], axis=0)

    def loss(w, theta):
        total = 0.0
        for (_, c), g in zip(rows, grades):
            cdf = [0.0, *(1 / (1 + math.exp(float(c / most @ w) - t)) for t in theta), 1.0]
            total -= math.log(cdf[g + 1] - cdf[g]) / (3 * (grades == g).sum())
        return total + l1 * np.abs(w).sum()

    w, theta = model.weights[:3].astype(float) * most, model.theta
    best = loss(w, theta)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(3)[k], theta) > best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, theta + step * np.eye(2)[k]) > best - 1e-6
