"""The pipeline as a whole, next to a plain version of it."""
import hashlib
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

from .test_models import ids
from .test_native import squeezed
from .test_near import classes, plain_tiles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_run_equals_a_plain_version(spark):
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    docs = [(i, t) for i, t in zip(*(pq.read_table(f"{SF}/documents.parquet", columns=[c]).column(0).to_pylist() for c in ("doc_id", "text")))]
    docs = [(i, t) for i, t in docs if any(map(str.isalpha, t or ""))]
    first = {}
    for i, t in docs:
        key = squeezed(t)
        first[key] = min(first.get(key, (1, 0, "")), (-len(t), i, t))
    docs = sorted((i, t) for _, i, t in first.values())
    kept = {}
    for label, (i, t) in zip(classes(docs), docs):
        kept.setdefault(label, (i, t))
    split = lambda t: re.findall(r"\w+", t.lower())
    items = [split(t) for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()]

    def clean(text):
        w = split(text)
        runs = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        return not any(runs & {tuple(i[k:k + 5]) for k in range(len(i) - 4)} and plain_tiles(i, w, 5) >= 0.5 * len(i) for i in items)

    want = []
    for i, t in kept.values():
        if clean(t):
            packed = np.array(ids(t), "<u4")
            want.append((i, len(packed), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "bpe" or docs.columns == columns, name
        assert docs.count() <= odd.count()
