"""Language profiles, the quality network and tokens: brute force, held-out accuracy, round trips."""
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from geoweft.llm import bpe, language, quality, queries

from .conftest import odd_rows, prose

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def plain_ngrams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i:i + 2] for i in range(len(padded) - 1))
        out.update(padded[i:i + 3] for i in range(len(padded) - 2))
    return out


def test_ngrams_equal_plain_counting():
    for text in ["Der Hund, der HUND.", "", "...", "a", "é ü-ö 12x"]:
        grams, counts = np.unique(language.ngrams(text), return_counts=True)
        names = ["".join(chr((g >> s) & 0x1FFFFF) for s in (0, 21, 42)) for g in grams.tolist()]
        want = plain_ngrams(text)
        assert sum(counts) == sum(want.values()) and sorted(counts) == sorted(want.values()), (text, names)


def test_distance_is_the_sum_of_rank_differences():
    profile = np.array([5, 3, 9, 1], np.int64)
    order = np.argsort(profile)
    own = np.array([3, 7, 5], np.int64)
    want = (abs(1 - 0) + language.PROFILE + abs(0 - 2)) / 3 / language.PROFILE
    assert language.distances(own, [(profile[order], order)])[0] == pytest.approx(want)


def test_language_of_odd_rows(odd, empty):
    out = language.identify(odd, language.train(odd), F.col("doc_id"), F.col("score").alias("kept"))
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    assert {r.lang_pred for r in rows} == {"en", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == "und" for r in rows) == sum(not any(map(str.isalpha, r[1] or "")) for r in odd_rows())
    left = language.identified_only(odd, language.train(odd))
    assert left.columns == odd.columns and left.count() == sum(any(map(str.isalpha, r[1] or "")) for r in odd_rows())
    assert language.identify(odd, language.train(empty), F.col("doc_id")).filter("lang_pred = 'und' AND score = 0").count() == len(odd_rows())
    assert language.identify(empty, {"en": np.array([1])}, F.col("doc_id")).count() == 0


def test_texts_with_a_letter_stay_without_training_texts(odd, empty):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    left = language.identified_only(docs, language.train(docs))
    assert left.columns == docs.columns
    assert Counter(r.text for r in left.collect()) == Counter(r[1] for r in odd_rows() if any(map(str.isalpha, r[1] or "")))
    assert language.identified_only(empty, {}).count() == 0


@data
def test_language_of_held_out_rows(spark):
    out = queries.QUERIES["op6_language_id"](spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    hit, n = out.filter("held_out").select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and hit / n > 0.98


@data
def test_quality_of_held_out_rows(spark):
    out = queries.QUERIES["op8_quality"](spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_quality_learns_and_stays_in_range(spark, odd, empty):
    docs = spark.createDataFrame([(i, (prose(i, 40).upper() + "!!") if i % 2 else prose(i, 40)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, "x") for i in range(300)] + [(7, None, ""), (9999, 1, "")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels, "quality", F.col("doc_id") < 200)
    scored = quality.score(docs, model, F.col("doc_id")).filter("doc_id >= 200").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in scored)
    rows = quality.score(odd, model, F.col("doc_id")).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model, F.col("doc_id")).count() == 0
    none = quality.train(empty, labels, "quality", F.lit(True))
    assert {r.score for r in quality.score(odd, none, F.col("doc_id")).collect()} == {0.5}


def test_quality_features():
    bucket, doc = quality.features(["ab ab", "", "x"])
    # words, pairs, n-grams of 2, 3 and 4 characters
    assert Counter(doc.tolist()) == Counter({0: 2 + 1 + 4 + 3 + 2, 2: 1})


TEXTS = [
    "Hello world's  end\n\n  x", "", " ", "a" * 700, "can't we'll 'sno '  s", "é ü 漢字かな 🙂🙂 \u00a0\u2003x", "1234 5678,9  \t\t\n", prose(1, 500), "   " * 100 + "x",
    "ab" * 400 + "\n" * 90 + "z", "\u0301\u0301 e\u0301", "x" * 3000 + " y", "'" * 50 + "s",
]


def ids(text):
    return TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (16, 8), (64, 20)])
def test_stitching_equals_the_library(chunk, overlap):
    r = random.Random(3)
    more = ["".join(r.choice(" \n'sté12.,漢a") for _ in range(300)) for _ in range(30)]
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in [*TEXTS, *more]:
        windows = []
        for at in range(0, max(len(text), 1), chunk):
            cut = text[at:at + chunk + overlap]
            found, packed = encoder.pieces(cut)
            windows.append((cut, len(cut), np.cumsum([len(p) for p in found], dtype=np.int64), np.cumsum([len(i) // 4 for i in packed], dtype=np.int64), b"".join(packed)))
        got = np.frombuffer(bpe.stitched(windows, encoder, chunk), "<u4").tolist()
        assert got == ids(text), text[:60]


def test_merges_of_long_runs_equal_short_ones(monkeypatch):
    r = random.Random(4)
    runs = ["".join(r.choice("abné ") for _ in range(40)).encode() for _ in range(40)]
    short = [bpe.merged(x, RANKS) for x in runs]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.merged(x, RANKS) for x in runs] == short
    together = bpe.merged_together(runs, bpe.Pairs(RANKS))
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == short and bpe.merged_together([], bpe.Pairs(RANKS)) == []


def test_encode_and_decode(spark, odd, empty):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS)] + [(0, "again", "c"), (None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for size in ({}, {"chunk": 50, "overlap": 10}, {"chunk": 50, "overlap": 10, "safe": None}):
        out = bpe.encode(df, RANKS, public_tokenizers.PATTERN, **size)
        assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((i, tuple(ids(t or ""))) for i, t, _ in rows)
        assert Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(out, RANKS).collect()) == Counter((i, (t or "").encode()) for i, t, _ in rows)
    assert bpe.encode(odd, RANKS, public_tokenizers.PATTERN).count() == len(odd_rows())
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
