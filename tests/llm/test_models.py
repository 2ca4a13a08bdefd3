"""Language ID, SentencePiece, chat transcripts and HTML extraction."""

from html.parser import HTMLParser

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwatch.llm import html_extract as page
from millwatch.llm.chat_format import RoleModel, START, STATES, SYMBOLS, format_chats, learn_roles, marker_of, parse_transcripts, transcript_lines, written
from millwatch.llm.language_id import _counted, drop_unidentified, identify, mixtures
from millwatch.llm.queries import llm_queries
from millwatch.llm.sentencepiece_codec import MODEL, SPACE, StreamingViterbi, codec, decode, encode, vocabulary

DOCS = "doc_id long, text string, lang string"


# --- language ID ---------------------------------------------------------------------------


def test_held_out_languages_are_recognised(spark, sf):
    got = llm_queries()["op4_language_id"](spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in both)
    held = [r for r in both if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 < r["score"] <= 1 for r in both if r["lang_pred"] != "und")


def test_mixture_follows_the_share_of_words():
    rng = np.random.default_rng(4)
    words = np.log(np.where(np.arange(300)[:, None] % 10 < np.array([7, 0, 0]), 1.0, 1e-3))
    words[:, 1] = np.log(np.where(np.arange(300) % 10 >= 7, 1.0, 1e-3))
    words[:, 2] = np.log(1e-3 * rng.random(300) + 1e-4)
    share, size = mixtures(words, np.array([300]))
    assert size[0] == 2 and np.allclose(share[0], [0.7, 0.3, 0], atol=0.02)
    one, size = mixtures(words[words[:, 0] == 0], np.array([210]))
    assert size[0] == 1 and one[0].tolist() == [1, 0, 0]


def test_counting_a_large_batch_takes_little_memory():
    texts = [f"word{i} and so on " * 400 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    whole = [b.to_pylist() for b in _counted(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3_500_000 and peak < 100 << 20
    assert whole == [b.to_pylist() for b in _counted(batch.slice(i, 1) for i in range(len(texts)))]


def test_language_edges(spark):
    rng = random.Random(1)
    speak = {"aa": ["bako", "tilu", "mora"], "bb": ["strng", "wchtz", "pfrk"]}
    rows = [(i, " ".join(rng.choices(speak[k], k=20)), k) for i in range(60) for k in ("aa", "bb")]
    edge = [(900, None, "aa"), (901, "", None), (902, "12 - 3!", "bb"), (903, "Strng " * 50_000, None), (None, "tilu mora", None), (903, "bako", "bb")]
    df = spark.createDataFrame(rows + edge, DOCS).withColumns({"score": F.lit(9), "cells": F.lit("x")})
    got = identify(df)
    assert got.columns == ["doc_id", "text", "lang", "cells", "lang_pred", "score", "languages", "held_out"]
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.where("doc_id >= 900 or doc_id is null").collect()]
    assert sorted(found, key=str) == sorted([(900, "und", 0), (901, "und", 0), (902, "und", 0), (903, "bb", 1), (None, "aa", 1), (903, "aa", 1)], key=str)
    kept = drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 3 and kept.where("lang is null").isEmpty()
    assert identify(df.limit(0)).isEmpty()
    nothing = identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


# --- SentencePiece ---------------------------------------------------------------------------


def some_texts():
    rng = random.Random(2)
    parts = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "é", "日本", "🙂", "Ａ", "==", "00", "\0", "the ", "xq", "аб"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["".join(rng.choice("abcdefghij") for _ in range(8000)), " " * 1000, "=" * 999, "", " ", "aaaaa" * 500]


def test_ids_equal_the_library():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec(MODEL)
    for text in some_texts():
        ids = own.encode(text).tolist()
        assert ids == library.encode(text), text[:80]
        assert own.decode(ids) == library.decode(ids) == text


def test_stream_holds_a_short_window_and_commits_early():
    import sentencepiece

    rng = random.Random(3)
    text = SPACE + "".join(rng.choice("etaoinsrh=") for _ in range(5000))
    search, pieces, widest = StreamingViterbi(vocabulary(MODEL)), [], 0
    for at in range(0, len(text), 7):
        pieces += search.feed(text[at : at + 7])
        widest = max(widest, len(search.text))
    pieces += search.finish()
    assert widest <= 6 * vocabulary(MODEL).longest
    assert pieces == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text[1:], out_type=str)


def test_codec_edges(spark):
    rows = [(1, "a b", None), (2, None, None), (3, "", None), (4, "word " * 60_000, None), (1, "a b", None), (None, f"x{SPACE}y", None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"ids": F.lit("x"), "round_trip": F.lit(1)})
    got = encode(df, check=True)
    assert got.columns == ["doc_id", "text", "lang", "ids", "n_ids", "round_trip"]
    seen = got.orderBy("doc_id", "text").collect()
    assert [(r["n_ids"], r["round_trip"]) for r in seen] == [(2, True), (2, True), (2, True), (0, None), (0, True), (60_001, True)]
    back = decode(got).where("text is not null").collect()
    assert all(r["decoded"] == r["text"].replace(SPACE, " ") for r in back)
    assert encode(df.limit(0)).isEmpty()


# --- chat ------------------------------------------------------------------------------------


def test_roles_and_texts_of_all_conversations_come_back(spark, sf):
    source = spark.read.parquet(f"{sf}/conversations.parquet").where("role in ('system', 'user', 'assistant')").collect()
    want = {}
    for r in sorted(source, key=lambda r: (r["conv_id"], r["turn"], r["role"])):
        want.setdefault(r["conv_id"], []).append((r["role"], (r["text"] or "").strip(" \t\r\n")))
    got = {}
    for r in llm_queries()["op7_chat_format"](spark, sf).orderBy("conv_id", "turn").collect():
        assert r["rendered"] == f"<|im_start|>{r['role']}\n{r['text']}<|im_end|>"
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == want


def test_markers():
    seen = {x: marker_of(x)[0] for x in ("User: hi", "**Assistant:** ok", "### Human:", "<AI> x", "[System] y", "Q1: z", "so: no", "User hi", "")}
    assert list(seen.values()) == ["user", "assistant", "user", "assistant", "system", "user", None, None, None]


def test_pieces_give_the_path_of_the_whole():
    rng = np.random.default_rng(6)
    model = RoleModel(rng.integers(0, 9, (START + 1, START)).astype(float), rng.integers(0, 9, (START, SYMBOLS)).astype(float))
    symbols = rng.integers(0, 12, 97)
    whole = model.path(symbols, None, None)
    cuts = [symbols[at : at + 20] for at in range(0, 97, 20)]
    score = model.first_scores(cuts[0])
    for c in cuts[1:]:
        score = (score[:, None] + model.step_scores(c)).max(axis=0)
    by_hand = model.start[whole[0]] + sum(model.shows[s, o] for s, o in zip(whole, symbols)) + sum(model.moves[a, b] for a, b in zip(whole, whole[1:]))
    assert np.isclose(score.max(), by_hand)
    ends = [whole[min(at + 19, 96)] for at in range(0, 97, 20)]
    joined = [s for k, c in enumerate(cuts) for s in model.path(c, ends[k - 1] if k else None, ends[k])]
    assert joined == whole


def test_long_and_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, ("user", "assistant")[t % 2], "\n".join(f"line {t} {k}" for k in range(t % 5))) for t in range(700)]
    rows += [(2, 0, "user", "User: not a turn\n\\slash\nA: nor this"), (2, None, "system", None), (2, 1, "narrator", "gone"), (None, 0, "user", "gone")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "assistant", "x" * 300_000)]
    got = {}
    for r in format_chats(spark.createDataFrame(rows, schema).withColumns({"place": F.lit("x"), "piece": F.lit(0)})).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got[1] == [(r[2], r[3]) for r in rows[:700]]
    assert got[2] == [("system", ""), ("user", "User: not a turn\n\\slash\nA: nor this")]
    assert got[3] == [("user", "same")] * 2 and got[4] == [("assistant", "x" * 300_000)] and None not in got
    assert format_chats(spark.createDataFrame([], schema)).isEmpty()


def test_raw_transcript_with_an_unmarked_start(spark):
    model = learn_roles(written(spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], "is it so?" if t % 2 == 0 else "it is so") for c in range(30) for t in range(4)], "conv_id long, turn long, role string, text string")))
    raw = spark.createDataFrame([(1, "is it so?\nAI: it is\nand more\n\nHuman: why?"), (2, None)], "conv_id long, text string")
    got = [tuple(r)[1:4] for r in parse_transcripts(transcript_lines(raw), model).orderBy("turn").collect()]
    assert got == [(0, "user", "is it so?"), (1, "assistant", "it is\nand more"), (2, "user", "why?")]
    assert len(STATES) == START


# --- HTML ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return page.learn(spark.read.parquet(f"{sf}/pages.parquet"))


def test_gradients():
    model, rng = page.Labeller(), np.random.default_rng(2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = page.padded([rng.normal(size=(5, page.WIDTH)), rng.normal(size=(3, page.WIDTH))])
    y = (rng.random(mask.shape) > 0.5).astype(float)

    def loss():
        s = model.scores(x, mask)
        return float(((np.log1p(np.exp(s)) - y * s) * mask).sum() / mask.sum())

    grads = model._gradients(x, mask, y)
    for name, at in (("xf", (3, 7)), ("hb", (2, 30)), ("bf", (25,)), ("out", (4,)), ("bias", (0,))):
        kept = model.p[name][at]
        around = []
        for step in (1e-3, -1e-3):
            model.p[name][at] = kept + step
            around.append(loss())
        model.p[name][at] = kept
        assert abs((around[0] - around[1]) / 2e-3 - grads[name][at]) < 2e-4, name


def test_held_out_pages_are_labelled_like_their_own_elements(spark, sf, labeller):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 150").collect()
    pages = [page.weakly_labelled(r["html"]) for r in rows]
    right = [(got == np.array(p.targets, bool)).all() for p, got in zip(pages, labeller.label(pages))]
    assert len(right) >= 90 and np.mean(right) > 0.95


def test_composed_pages(labeller):
    rng = np.random.default_rng(77)
    other = [" ".join(f"word{k}" for k in rng.integers(0, 500, 20)) + "." for _ in range(60)]
    pages = [page.parse(page.compose(rng, list(rng.choice(other, 8)), other)) for _ in range(120)]
    wrong = sum((got != np.array(p.targets, bool)).sum() for p, got in zip(pages, labeller.label(pages)))
    assert wrong / sum(len(p.texts) for p in pages) < 0.05


def test_parser():
    source = """<!doctype html><title>T</title><script>var a="</p><p>";</script><style>p{}</style><!-- <p>no</p> -->
    <article><h1>A &amp; B</h1><p>one<b> two</b><br>three&nbsp;&lt;x&gt;<p>four &am<ul><li>five<li>six</ul>a < b</article><p title="a>b">end &copy"""
    assert page.parse(source).texts == ["A & B", "one two three <x>", "four &am", "five", "six", "a < b", "end ©"]
    for odd in ("", "<", "<p", "<!--", "<p>x<script>y", '<a href="', "</div></div>x", "<div>" * 5000 + "deep"):
        page.parse(odd)
    assert page.parse("<p>x<script>y").texts == ["x"] and page.parse("<div>" * 5000 + "deep").texts == ["deep"]


def test_page_edges(spark, labeller):
    long = "<article>" + "<p>Plain words in a sentence.</p>" * 5_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav>"), (4, "u", long), (4, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = page.extract(df, labeller).orderBy("page_id", "url").collect()
    assert [(r["page_id"], r["n_chars"]) for r in got[:3]] == [(None, 0), (1, 0), (2, 0)]
    assert got[3] == got[4] and got[3]["n_chars"] == len(got[3]["text"]) > 100_000
    assert page.extract(df.limit(0)).isEmpty()


def test_a_document_may_hold_every_language():
    """Seven equal shares of seven languages, one language, and two: the penalty alone bounds the set."""
    import numpy as np

    from millwatch.llm.language_id import mixtures

    spoken = [np.arange(700) % 7, np.full(300, 2), np.arange(400) % 2]
    words = np.concatenate([np.where(np.arange(7) == s[:, None], 0.0, -6.0) for s in spoken])
    share, size = mixtures(words, np.array([len(s) for s in spoken]))
    assert size.tolist() == [7, 1, 2]
    assert np.allclose(share[0], 1 / 7, atol=0.01) and share[1, 2] == 1 and np.allclose(share[2, :2], 0.5, atol=0.01)


def test_stray_quotes_and_plain_elements_lose_no_text():
    """Quotes delimit only after an equals sign; elements that hold ordinary text are read."""
    source = "<article><p>one</p><p title=Bob's>two</p><p title='it > is' data-x = \"a>b\">three</p><p class=\"a\"b>four \"five\"</p>"
    source += "<noscript>six</noscript> <math><mi>x</mi>=<mn>7</mn></math> <object>eight</object><p it's>nine</p></article><p>ten"
    assert " ".join(page.parse(source).texts) == 'one two three four "five" six x=7 eight nine ten'


class Reader(HTMLParser):
    """The article's text as Python's own parser sees it, without any labelling."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.blocks = 0, 0, [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.inside += tag == "article"
        if tag in ("p", "h1", "h2", "li", "article", "ul", "blockquote", "figure", "figcaption", "table", "tr", "td", "th", "pre", "h3"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.inside -= tag == "article"
        if tag not in ("a", "b", "em", "i", "span", "strong", "code", "br"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data

    def text(self):
        return [" ".join(b.split()) for b in self.blocks if b.split()]


def test_article_blocks_equal_an_independent_reader(spark, sf):
    """Of every page with one article, the parser's blocks inside it are those that Python's parser finds, joined text against joined text."""
    rows = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect() if r["html"]]
    checked = 0
    for source in rows:
        if source.count("<article") != 1 or "</article>" not in source:
            continue
        inner = source[source.index("<article") : source.index("</article>") + len("</article>")]
        assert "\n".join(page.parse(inner).texts) == "\n".join(Reader(inner).text())
        checked += 1
    assert checked > 20
