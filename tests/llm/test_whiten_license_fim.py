"""Whitening, license scans and fill-in-the-middle against plain Python."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.llm import fill_in_middle, licenses, queries, whitening

from .conftest import odd_rows, prose


# ---- whitening -----------------------------------------------------------------

def plain_whitening(rows, components=4):
    """(id, component) -> values, with Python's integers and numpy's eigenvectors."""
    kept = defaultdict(list)
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept[len(v)].append((i, tuple(max(-2**63, min(2**63 - 1, math.floor(256 * c))) for c in v)))
    out = []
    for dim, own in kept.items():
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        off = {x: [n * a - s for a, s in zip(x, sums)] for x in fit}
        covariance = np.array([[sum(o[i] * o[j] for o in off.values()) / n**3 for j in range(dim)] for i in range(dim)])
        values, vectors = np.linalg.eigh(covariance)
        for i, x in own:
            for k in range(1, min(components, dim) + 1):
                e, v = values[-k], vectors[:, -k]
                white = None if e <= 1e-12 * covariance.trace() else sum(o / n * a for o, a in zip(off[x], v)) / math.sqrt(e)
                out.append((i, dim, k, n, sum(o * o for o in off[x]), white, e / covariance.trace() if covariance.trace() else 0.0))
    return out


def vectors():
    r = random.Random(4)
    out = [(i, [r.gauss(0, 0.3) * (1 + d) for d in range(6)]) for i in range(300)]
    out += [(300 + i, out[7][1]) for i in range(100)]  # a third of all rows are copies
    out += [(None, out[3][1]), (3, out[3][1]), (900, None), (901, [None] * 6), (902, [math.nan, *[0.0] * 5]), (903, [math.inf, *[0.0] * 5]), (904, []), (905, [-0.0] * 6)]
    out += [(1000 + i, [2.0, r.gauss(0, 1e15), float(i)]) for i in range(9)] + [(2000 + i, [1.5, -1.5]) for i in range(3)]
    return out


@pytest.mark.parametrize("rows", [whitening.BLOCK_ROWS, 64])
def test_whitening_equals_plain(spark, monkeypatch, rows):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", rows)
    table = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", -1) for i, v in table], "vec_id long, embedding array<double>, component int, id string, n int").repartition(3)
    got = whitening.whiten(df).collect()
    want = plain_whitening(table)
    assert Counter((r.vec_id, r.component, r.n, int(r.deviation)) for r in got) == Counter((i, k, n, d) for i, _, k, n, d, _, _ in want)
    shares = {(n, k): e for _, _, k, n, _, _, e in want}
    assert all(r.explained == pytest.approx(shares[r.n, r.component], rel=1e-6, abs=1e-9) for r in got)
    for dim in (2, 3, 6):
        mine = [r for r in got if r.vec_id is not None and (r.vec_id < 1000 if dim == 6 else r.vec_id >= 2000 if dim == 2 else 1000 <= r.vec_id < 2000)]
        for k in range(1, min(dim, 4) + 1):
            ours = {r.vec_id: r.whitened for r in mine if r.component == k}
            plain = {i: w for i, d, c, _, _, w, _ in want if d == dim and c == k and i is not None}
            assert (set(ours.values()) == {None}) == (set(plain.values()) == {None})
            if set(ours.values()) != {None}:
                sign = max((ours[i] * plain[i] for i in ours), key=abs) > 0 or -1
                assert all(ours[i] == pytest.approx(sign * plain[i], rel=1e-6, abs=1e-6) for i in ours)
    assert all(r.identity_error is None or 0 <= r.identity_error < 1e-6 for r in got)
    assert {r.identity_error is None for r in got if r.vec_id and r.vec_id >= 2000} == {True}


def test_scatter_is_exact_at_any_size():
    r = np.random.default_rng(1)
    for x in (r.integers(-5, 9, (1000, 5)), r.integers(-2**63, 2**63 - 1, (130, 3)), np.full((7, 2), 4), r.integers(0, 2, (64, 4)), r.integers(-9, 9, (1, 1))):
        sums, products = whitening.scatter(x.astype(np.int64))
        o = x.astype(object)
        i, j = np.triu_indices(x.shape[1])
        assert list(sums) == list(o.sum(axis=0))
        assert list(products) == [(o[:, a] * o[:, b]).sum() for a, b in zip(i, j)]


def test_whitening_of_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


# ---- licenses --------------------------------------------------------------------

LICENSES = [
    "Licensed under CC BY-NC 4.0.", "the GNU General\n Public License", "the GNU General\n  Public -- License v3; All rights reserved. all RIGHTS reserved",
    "ALL RIGHTS RESERVED", "cc by cc by cc by", "ccby cc-by.CC BY", "é cc byé cc", "İcc by", "Released under the MIT License.",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
    "SPDX-License-Identifier GPL", "spdx-license-identifier:(MIT", "x SPDX-License-Identifier: MIT and", "SPDX-License-Identifier:\nMIT",
    "GNU Lesser General Public License", "general public", "license general public license", None, "", " \n", "cc", "0cc by", "[cc]`by`{~by}",
]


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    first = [k for k, _ in places]
    return len(words), len(places), min(first, default=None), max(first, default=None), sorted({label for _, label in places})


@pytest.mark.parametrize("window", [licenses.WINDOW, 40, 7])
def test_licenses_equal_plain(spark, odd, monkeypatch, window):
    r = random.Random(5)
    made = [" ".join(r.choice(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x" * 50, "é"]) + r.choice([" ", "-", "\n" * 9, ""])
                     for _ in range(r.randint(1, 300))) for _ in range(40)]
    monkeypatch.setattr(licenses, "WINDOW", window)
    for text in [*LICENSES, *made, " " * 500 + "cc" + " " * 500 + "by", "cc" + "-" * 100]:
        f = licenses.scan_text((text or "").encode())
        assert (f.n_words, f.n_base, f.first_word, f.last_word, sorted(f.base_labels)) == plain_licenses(text), text
        assert f.base_labels <= f.labels and 0 <= f.score <= 1


def test_license_table(spark, odd, empty):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSES)], "doc_id long, text string, labels string")
    for r in licenses.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(LICENSES[r.doc_id])
        assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels))
    got = Counter((r.doc_id, r.n_words) for r in licenses.scan(odd).collect())
    assert got == Counter((i, plain_licenses(t)[0]) for i, t, *_ in odd_rows())
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("expression, labels, binds", [
    ("MIT", {"mit"}, 0.25), ("GPL-2.0-only or MIT", {"gpl", "mit"}, 0.25), ("GPL-2.0-only and MIT", {"gpl", "mit"}, 0.75),
    ("MIT or GPL-3.0 and Apache-2.0", {"mit", "gpl", "apache"}, 0.25), ("(MIT or GPL-3.0) and AGPL-3.0", {"mit", "gpl", "agpl"}, 0.75),
    ("GPL-2.0 with Classpath-exception-2.0", {"gpl"}, 0.5), ("GPL-2.0 with X and MIT or GPL-2.0", {"gpl", "mit"}, 0.5),
    ("MIT GPL-2.0", {"mit"}, 0.25), ("", set(), 0.0), ("(GPL-2.0 or MIT", {"gpl", "mit"}, 0.75), ("MIT or", {"mit"}, 0.25), (") MIT", set(), 0.0),
    ("LicenseRef-own", {"licenseref-own"}, 0.5), ("((MIT))", {"mit"}, 0.25), ("MIT) and GPL-2.0", {"mit"}, 0.25),
])
def test_license_expressions(expression, labels, binds):
    assert licenses.evaluate(licenses.tokens(expression.encode())) == (labels, binds)


def test_tags_and_notices():
    f = licenses.scan_text(LICENSES[9].encode())
    assert f.labels == {"mit", "gpl", "apache"} and f.score == 0.25
    assert licenses.scan_text(LICENSES[8].encode()).labels == {"mit"}
    assert licenses.scan_text(LICENSES[0].encode()).labels == {"cc-by", "cc-by-nc"}
    assert licenses.scan_text(LICENSES[15].encode()).labels == {"gpl", "lgpl"}
    assert not licenses.scan_text(LICENSES[11].encode()).labels and not licenses.scan_text(LICENSES[14].encode()).labels


# ---- fill in the middle ------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return doc_id, n, form, *chars, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def fim_rows():
    r = random.Random(6)
    texts = ["<P>", "a<S>b", "x <M", "<", "é", "日本語 text", "a" * 3000, "a" * 2000 + "1" + "b" * 2000, "\n\n", "a1" * 700, "𝄞" * 40, "ends<P", "<S" + "<" * 70 + "M>" + "x" * 70]
    texts += ["".join(r.choice("ab <>PSM\né日1") for _ in range(r.randint(1, 400))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in odd_rows()] + [(-5, "minus five")]


@pytest.mark.parametrize("size", [fill_in_middle.FRAME_BYTES, 64, 1])
def test_fill_in_middle_equals_plain(spark, monkeypatch, size):
    monkeypatch.setattr(fill_in_middle, "FRAME_BYTES", size)
    rows = [(i, t) for i, t in fim_rows() if size > 1 or len(t or "") < 600]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, row long").repartition(4)
    got = Counter(tuple(r) for r in fill_in_middle.digests(df).collect())
    want = Counter(plain_fim(i, t) for i, t in rows)
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_outputs_and_frames(spark, monkeypatch, empty):
    import zstandard
    monkeypatch.setattr(fill_in_middle, "FRAME_BYTES", 50)
    rows = fim_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(list)
    for r in fill_in_middle.outputs(df).collect():
        found[r.row, r.doc_id, r.form].append((r.section, r.no, zstandard.ZstdDecompressor().decompress(r.payload)))
    got = Counter((i, form, hashlib.sha256(b"".join(p for *_, p in sorted(pieces))).hexdigest()) for (_, i, form), pieces in found.items())
    assert got == Counter((i, form, digest) for i, _, form, _, _, digest, _ in (plain_fim(*x) for x in rows))
    table = fill_in_middle.frames(df)
    assert table.filter("length(payload) > 200").count() == 0 and table.filter("first_unit + frame_units > units").count() == 0
    # cumulative counts: each frame begins where the one before ends
    after = table.groupBy("row").agg(F.sum("frame_units").alias("s"), F.max("units").alias("u"), F.count("*").alias("k"), F.max("frames").alias("f"))
    assert after.filter("s != u OR k != f").count() == 0
    assert fill_in_middle.digests(empty).count() == fill_in_middle.outputs(empty).count() == 0


@pytest.mark.parametrize("name", ["op11_whitening", "op12_licenses", "op13_fill_in_middle"])
def test_registered(name):
    assert name in queries.QUERIES
