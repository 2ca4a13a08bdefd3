"""Each pipeline stage on its own input, held to plain Python: clashing names, nulls, empties, repeats, one very long text."""

import random
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from millwatch.llm.language_id import identify
from millwatch.llm.line_dedup import dedup_lines
from millwatch.llm.sentencepiece_codec import MODEL, SPACE, decode, encode
from tests.llm.test_text_dedup import fingerprint_by_hand, groups_by_hand, noisy_docs

STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ["a.b", "__", "__row", "__kept", "__mix_n", "SCORE", "N_LINES", "held_out", "languages", "h", "fp", "batch", "copies"]


def nasty(spark, empty=False):
    rng = random.Random(3)
    words = {"en": "the and house water which", "de": "der und haus wasser welche", "fr": "le et maison eau quelle"}
    rows = []
    for i, (doc, text) in enumerate(noisy_docs(2)):
        lang = rng.choice(list(words))
        said = None if text is None else text if not text.strip() else " ".join(rng.choices(words[lang].split(), k=9)) + "\n" + text
        rows.append((doc, said, lang if i % 5 else None, rng.choice(["x", "y", None]), 1 if text is None else len(text)))
    df = spark.createDataFrame(rows[:0] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).withColumns({c: F.coalesce(F.concat(F.lit(f"{k}:"), "source"), F.lit(f"{k}")) for k, c in enumerate(CLASHES)})


def run(spark, name, docs):
    got = STAGES[name](spark, docs, None)
    return got, [r.asDict() for r in got.collect()]


def others(row):
    return tuple(row[c] for c in CLASHES)


def test_stage_names_are_the_pipeline():
    assert list(STAGES) == ["language_id", "line_dedup", "simhash_dedup", "mixing", "sentencepiece"]


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_stays_empty_with_its_columns(spark, name):
    docs = nasty(spark, empty=True)
    got, rows = run(spark, name, docs)
    assert rows == [] and got.columns == docs.columns + (["ids", "n_ids", "round_trip"] if name == "sentencepiece" else [])


def test_language_stage_keeps_every_text_with_letters(spark):
    docs = nasty(spark)
    got, rows = run(spark, "language_id", docs)
    kept = [r.asDict() for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    key = lambda r: (r["doc_id"], r["text"], r["source"], r["n_chars"], *others(r))
    assert got.columns == docs.columns and Counter(map(key, rows)) == Counter(map(key, kept))
    assert {r["lang"] for r in rows} <= {"en", "de", "fr"}


def test_line_stage_equals_plain_python(spark):
    docs = nasty(spark)
    got, rows = run(spark, "line_dedup", docs)
    source = [r.asDict() for r in docs.collect()]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    keyed = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    first = {}
    for r in source:
        for x in (r["text"] or "").split("\n") if r["doc_id"] is not None else ():
            first[keyed(x)] = min(first.get(keyed(x), r["doc_id"]), r["doc_id"])
    stays = lambda r, x: r["doc_id"] is None or len(keyed(x)) < 10 or first[keyed(x)] >= r["doc_id"]
    want = []
    for r in source:
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if stays(r, x))
        want.append((r["doc_id"], text, None if text is None else len(text), r["lang"], r["source"], *others(r)))
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["n_chars"], r["lang"], r["source"], *others(r)) for r in rows) == Counter(want)


def test_simhash_stage_equals_plain_python(spark):
    docs = nasty(spark)
    got, rows = run(spark, "simhash_dedup", docs)
    source = [r.asDict() for r in docs.collect()]
    roots = groups_by_hand([r["doc_id"] for r in source], [fingerprint_by_hand(r["text"]) for r in source])
    want = Counter(tuple(r.values()) for r, root in zip(source, roots) if r["doc_id"] == root)
    assert got.columns == docs.columns and Counter(tuple(r.values()) for r in rows) == want


def test_mixing_stage_takes_whole_rows_near_their_targets(spark):
    docs = nasty(spark)
    got, rows = run(spark, "mixing", docs)
    source = [tuple(r) for r in docs.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = Counter(source), Counter(tuple(r.values()) for r in rows)
    assert got.columns == docs.columns and set(after) <= set(before) and all(after[k] <= 3 * before[k] for k in after)
    total, sizes, taken = sum(size(r[1]) for r in source), Counter(), Counter()
    for r in source:
        sizes[r[3]] += size(r[1])
    for k, n in after.items():
        taken[k[3]] += n * size(k[1])
    weight, left, target = {"x": 1, "y": 2, None: 3}, {"x", "y", None}, {}
    while left:
        rest = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if 3 * sizes[s] <= rest * weight[s]}
        target.update({s: 3 * sizes[s] if full else rest * weight[s] for s in (full or left)})
        left -= full or left
    longest = max(size(r[1]) for r in source)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)


def test_sentencepiece_stage_equals_the_library(spark):
    docs = nasty(spark)
    got, rows = run(spark, "sentencepiece", docs)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got.columns == docs.columns + ["ids", "n_ids", "round_trip"] and len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else model.encode(r["text"])) and r["round_trip"] in (True, None)


def test_operators_replace_columns_named_like_new_ones_in_any_case(spark):
    docs = nasty(spark).withColumns({"IDS": F.lit(1), "Lang_Pred": F.lit(2), "Kept_sha256": F.lit(3), "Decoded": F.lit(4)})
    coded = decode(encode(docs))
    assert coded.where("text is not null").where(F.col("decoded") != F.translate("text", SPACE, " ")).isEmpty()
    for got in (coded, identify(docs), dedup_lines(docs)):
        lower = [c.lower() for c in got.columns]
        assert len(lower) == len(set(lower)) and "a.b" in got.columns and got.count() == docs.count()
