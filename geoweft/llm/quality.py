"""A quality classifier of supervised subword embeddings.

A text's features are its words, pairs of neighbouring words and character n-grams, hashed
into buckets; every bucket has a learned vector, a text the average of its features' vectors,
and a softmax layer over that average gives the classes' probabilities. Vectors and layer are
trained together by stochastic gradient descent in numpy.

The network is fitted in one task on at most `TRAIN_ROWS` labelled texts, those whose ids'
hashes are lowest, so its work is bounded; scoring reads every text whole. As layer and average
are both linear, a trained network scores by one number per bucket.

Defined cases: a null text counts as empty, and a text without features scores by the bias
alone; null labels and labels without a document teach nothing; repeated rows count each time;
without two classes to learn from, the score is the share of class 1 (0.5 if there is none);
an empty table gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts
from .words import U, mix, words

BUCKETS, WIDTH = 1 << 16, 8
GRAMS = (2, 3, 4)
# Labelled texts the network is fitted on, at most.
TRAIN_ROWS = 4_000
EPOCHS, RATE, SEED = 12, 0.5, 7
# Texts whose gradients are applied together.
BATCH = 16

_STEP = U(0x9E3779B97F4A7C15)


def features(all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of every text."""
    codes = np.frombuffer("\x00".join([*all_texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    doc = np.repeat(np.arange(len(all_texts)), [len(t) + 1 for t in all_texts])
    found = words(all_texts)
    near = found.doc[1:] == found.doc[:-1]
    # the difference of two words names the pair; that of a repeated word is always 0
    pair = mix(found.hashes[1:][near] - found.hashes[:-1][near] + U(1))
    hashed, owner = [mix(found.hashes + U(2)), pair], [found.doc, found.doc[1:][near]]
    value = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        value = value[:-1] * _STEP + codes[n - 1:]
        if n in GRAMS:
            inside = doc[:len(value)] == doc[n - 1:]
            # the last character of each text is the mark between texts
            inside &= codes[n - 1:] != 0
            hashed.append(mix(value[inside] + U(n)))
            owner.append(doc[:len(value)][inside])
    return (np.concatenate(hashed) % U(BUCKETS)).astype(np.int32), np.concatenate(owner).astype(np.int64)


def _averaged(all_texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct buckets and their shares of its features."""
    out = []
    for text in all_texts:
        bucket, _ = features([text])
        at, counts = np.unique(bucket, return_counts=True)
        out.append((at.astype(np.int32), (counts / max(len(bucket), 1)).astype(np.float32)))
    return out


def fit(all_texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """One number per bucket, and the bias: the log-odds of class 1 is the bias plus the
    average of a text's features' numbers."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        limit = 30.0
        return np.zeros(BUCKETS, np.float32), float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -limit, limit))
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    samples = _averaged(all_texts)
    steps, done = EPOCHS * -(-len(samples) // BATCH), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(samples))
        for first in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            for i in order[first:first + BATCH]:
                at, part = samples[i]
                mean = part @ vectors[at]
                logits = mean @ layer + bias
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[labels[i]] -= 1
                back = layer @ error
                layer -= rate * np.outer(mean, error)
                bias -= rate * error
                # a bucket's step doesn't shrink with the length of the text it stands in
                vectors[at] -= (rate * part * np.float32(len(at) ** 0.5))[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _fitted(batches):
    all_texts, labels = [], []
    for batch in batches:
        all_texts += texts(batch)
        labels += batch.column("label").to_pylist()
    weights, bias = fit(all_texts, np.array(labels, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, label_col: str, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fit to the labels (0 or 1) of the rows that `learn_from`, a condition on the labels'
    table, holds for."""
    named = labels.filter(learn_from).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    chosen = named.orderBy(F.xxhash64("id"), "label").limit(TRAIN_ROWS)  # TRAIN_ROWS ids at most, so fit to be broadcast
    sample = rows.join(F.broadcast(chosen), "id").select(F.coalesce("text", F.lit("")).alias("text"), "label", "id")
    # rows of repeated ids must not lift the bound
    sample = sample.orderBy(F.xxhash64("id"), "label", "text").limit(TRAIN_ROWS)
    model = sample.coalesce(1).mapInArrow(_fitted, "weights binary, bias double").collect()  # one row of 256 KB
    if not model:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model[0].weights, np.float32), model[0].bias


def _scored(batches, weights, bias):
    for batch in slices(batches):
        bucket, doc = features(texts(batch))
        n = batch.num_rows
        total = np.bincount(doc, weights[bucket], n)
        count = np.bincount(doc, minlength=n)
        logit = np.clip(bias + total / np.maximum(count, 1), -30, 30)
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(1 / (1 + np.exp(-logit)))], ["rest", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row (all if none are named) with score, the probability of
    class 1."""
    rest = F.struct(*(keep or [docs[c] for c in docs.columns]))
    rows = docs.select(rest.alias("rest"), docs[text_col].cast("string").alias("text"))
    schema = rows.select("rest", F.lit(0.0).alias("score")).schema
    weights, bias = model
    return rows.mapInArrow(partial(_scored, weights=weights, bias=bias), schema).select("rest.*", "score")
