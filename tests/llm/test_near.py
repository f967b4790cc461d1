"""Signatures, classes and decontamination against brute force."""
import os
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from geoweft.llm import decontaminate, near_dedup, queries
from geoweft.llm.components import components
from geoweft.llm.words import words

from .conftest import odd_rows, prose

SMALL = "/root/testdata/sf0.01"


def shingles(text, by_count=False):
    w = re.findall(r"\w+", (text or "").lower())
    found = Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    return found if by_count else Counter(set(found))


def classes(rows, by_count=False):
    """Places of the rows of each class."""
    own = [shingles(t, by_count) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if own[a] and own[b] and sum((own[a] & own[b]).values()) >= 0.8 * sum((own[a] | own[b]).values()):
            parent[find(b)] = find(a)
    return [find(k) for k in range(len(rows))]


def expected(rows, by_count=False):
    label = classes(rows, by_count)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[label[k]] = min(first.get(label[k], (True, 0)), (i is None, i or 0))
    size = Counter(label)
    return Counter((i, None if first[label[k]][0] else first[label[k]][1], size[label[k]]) for k, (i, _) in enumerate(rows)), len(size)


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("new" + w if r.random() < share else w for w in text.split())


def mixed_rows():
    rows = [(i, prose(i, 120)) for i in range(20)]
    rows += [(100 + k, edited(prose(k % 5, 120), share, k)) for k, share in enumerate([0.01, 0.02, 0.03, 0.05, 0.08] * 8)]
    passage = prose(999, 90)
    rows += [(200 + k, passage + " " + prose(2000 + k, 10 + k)) for k in range(25)]  # near each other in varying degrees
    return rows + [(300 + k, "again and again " * (30 + k)) for k in range(6)] + [(320 + k, prose(3000 + k, 12) + " so it is so" * 60) for k in range(4)]


def test_words_and_shingles():
    texts = ["One two, two_3  fünf! One TWO", "", "...", "a b c d e f", "ſ\u0130x y"]
    found = words(texts)
    assert list(np.diff(found.first)) == [len(re.findall(r"\w+", t.lower())) for t in texts]
    assert found.hashes[0] == found.hashes[4] and found.hashes[1] != found.hashes[0]
    _, doc, at = found.shingles(5)
    assert Counter(doc.tolist()) == Counter({0: 2, 3: 2, 4: 1})
    whole = found.whole()
    assert (words(["a  B c, D e F"]).whole()[0] == whole[3]).all() and (whole[1] == 0).all()


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    hashes = rng.integers(1, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    wb[:300] = wa[:300]
    element, weight = np.concatenate([hashes, hashes]), np.concatenate([wa, wb])
    doc = np.repeat([0, 1], 400)
    sig = near_dedup.signatures(element, doc, weight, 2)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.1
    alone = near_dedup.signatures(hashes, np.zeros(400, np.int64), wa, 1)
    assert (alone[0] == sig[0]).all()  # whatever else is in the batch
    tiny = near_dedup.signatures(hashes[:1], np.zeros(1, np.int64), np.ones(1), 1)
    assert (tiny != np.iinfo(np.uint64).max).all()


def test_fractional_weights():
    hashes = np.arange(1, 201, dtype=np.uint64)
    one = near_dedup.signatures(np.tile(hashes, 2), np.repeat([0, 1], 200), np.repeat([0.4, 0.8], 200), 2)
    assert abs((one[0] == one[1]).mean() - 0.5) < 0.15


@pytest.mark.parametrize("rows, by_count", [(mixed_rows(), False), (mixed_rows(), True), ([r[:2] for r in odd_rows()], False)], ids=["mixed", "counts", "odd"])
def test_classes_equal_brute_force(spark, odd, rows, by_count):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) if len(rows) > 50 else odd
    got = near_dedup.near_dedup(df, by_count=by_count).collect()
    want, n = expected(rows, by_count)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == n


def test_dedup_keeps_one_of_each_class(odd):
    left = near_dedup.deduplicated(odd)
    rows = left.collect()
    assert left.columns == odd.columns
    _, n = expected([r[:2] for r in odd_rows()])
    assert len(rows) == n
    assert sum(r.text is None for r in rows) == 3  # texts without words are classes of their own


def test_dedup_of_texts_whose_words_java_and_python_tell_apart(spark):
    # marks and connectors are no words here but are in Java's (?U)\\w; of a fraction it is the other way round
    rows = [(1, prose(1, 30)), (2, prose(1, 30)), (2, "\u0301\u0301"), (2, "\u203f"), (1, "\u00bd"), (2, "\u00bd")]
    left = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert Counter(map(tuple, left.collect())) == Counter(rows[k] for k in (0, 2, 3, 4))


def test_production_weighs_by_counts(spark, tmp_path):
    rows = [(k, prose(3000 + k, 12) + " so it is so" * 60) for k in range(4)] + [(10 + k, prose(20 + k, 80)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want, n = expected(rows, by_count=True)
    assert n == 4 and expected(rows)[1] == 7
    got = queries.QUERIES["op3_near_dedup"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, str(tmp_path)).collect()) == [0, 10, 11, 12]


def test_components_of_paths_and_stars(spark):
    links = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(100, 140)] + [(b"900", b"%03d" % i) for i in range(300, 360)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a binary, b binary")).collect()))
    assert {bytes(v) for k, v in got.items() if bytes(k) < b"200"} == {b"100"} and {bytes(v) for k, v in got.items() if bytes(k) > b"200"} == {b"300"}


def plain_tiles(item, text, least):
    """Greedy string tiling, word by word."""
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return covered
        free_i[i:i + n], free_t[t:t + n] = [False] * n, [False] * n
        covered += n


def test_tiles_equal_plain_tiling():
    r = random.Random(5)
    for _ in range(60):
        item = np.array([r.randint(1, 6) for _ in range(r.randint(1, 30))], np.uint64)
        text = np.array([r.randint(1, 6) for _ in range(r.randint(1, 60))], np.uint64)
        laid = decontaminate.tiles(item, text, 3)
        assert sum(n for *_, n in laid) == plain_tiles(item.tolist(), text.tolist(), 3)
        assert len({p for i, _, n in laid for p in range(i, i + n)}) == sum(n for *_, n in laid)


def test_rolled_hashes_equal_sums_over_each_run():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 400):
        tokens = r.integers(0, 2**64, n, np.uint64)
        rolling = decontaminate._Rolling(tokens)
        for size in {1, 2, 5, n, n + 1} - {0}:
            want = [sum(int(t) * pow(int(decontaminate._PAIR), j, 2**64) for j, t in enumerate(tokens[i:i + size])) % 2**64 for i in range(n - size + 1)]
            assert rolling.runs(size).tolist() == want


def test_items_with_text_ids_in_several_blocks(spark, monkeypatch):
    """Blocks are cut by words, whatever stands between them."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    items = [(f"item {k}", prose(7000 + k, 30).replace(" ", "\n\t")) for k in range(6)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert [len(ids) for ids, _ in decontaminate._blocks(benchmark, "item_id", "text")] == [1] * 6
    df = spark.createDataFrame([(k, prose(k, 20) + " " + prose(7000 + k, 30)) for k in range(8)], "doc_id long, text string")
    got = decontaminate.contaminated(df, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, f"item {k}") for k in range(6)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(df, benchmark).collect()) == [6, 7]


def test_decontamination(spark, odd, empty, monkeypatch):
    items = [(k, prose(5000 + k, 30)) for k in range(7)] + [(50, None), (51, ""), (52, "tiny item"), (53, prose(5000, 30))]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, id string")
    w = items[1][1].split()
    shuffled = " ".join(w[20:] + ["zz"] + w[10:20] + ["yy"] + w[:10])
    docs = [(1, prose(1, 50) + " " + items[0][1].upper() + "!"), (2, shuffled), (3, " ".join(w[:10])), (4, prose(2, 300)), (5, "a tiny, item"), (6, None),
            (7, " ".join(w[:16])), (8, items[2][1] + " " + items[3][1]), (8, items[2][1])]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, coverage string")
    want = Counter([(1, 0), (1, 53), (2, 1), (5, 52), (7, 1), (8, 2), (8, 3), (8, 2)])
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark).collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, benchmark).collect()) == want
    left = decontaminate.decontaminated(df, benchmark)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 6]
    assert decontaminate.decontaminated(odd, benchmark).count() == len(odd_rows())
    assert decontaminate.contaminated(empty, benchmark).count() == decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def test_empty_tables(empty):
    assert near_dedup.near_dedup(empty).count() == near_dedup.deduplicated(empty).count() == 0


def linked(rows):
    """Pairs of rows of a similarity of 0.8 or more with counts as weights, by an inverted index."""
    own = [shingles(t, True) for _, t in rows]
    total = [sum(o.values()) for o in own]
    held, common = {}, Counter()
    for k, o in enumerate(own):
        for s, n in o.items():
            for j, m in held.setdefault(s, []):
                common[j, k] += min(n, m)
            held[s].append((k, n))
    return [(a, b) for (a, b), c in common.items() if c >= 0.8 * (total[a] + total[b] - c)]


def labels_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(b)] = find(a)
    return [find(k) for k in range(n)]


def recall(spark, rows, text_ids=False):
    """Links, how many of them lie in one class, and whether the classes are the same."""
    kind = "string" if text_ids else "long"
    df = spark.createDataFrame([(str(i) if text_ids else i, t) for i, t in rows], f"doc_id {kind}, text string").repartition(4)
    found = {int(r.doc_id): r.class_id for r in near_dedup.near_dedup(df).collect()}
    pairs = linked(rows)
    same = len({(label, found[i]) for label, (i, _) in zip(labels_of(len(rows), pairs), rows)}) == len(set(found.values()))
    return len(pairs), sum(found[rows[a][0]] == found[rows[b][0]] for a, b in pairs), same


def test_a_large_group_near_the_threshold(spark, monkeypatch):
    """Copies that are about as far from each other as the threshold: no link of theirs is lost,
    and what is compared doesn't grow with the square of the group."""
    base, line = prose(5000, 110), prose(5001, 12)
    rows = [(k, line + "\n" + edited(base, [0.005, 0.01, 0.02, 0.03][k % 4], 7000 + k)) for k in range(400)]
    rows += [(1000 + k, line + "\n" + prose(9000 + k, 60)) for k in range(300)]
    compared = []
    similar = near_dedup._Corpus.similar

    def spied(self, pairs):
        compared.append(pairs.distinct().count())
        return similar(self, pairs)

    monkeypatch.setattr(near_dedup._Corpus, "similar", spied)
    links, met, same = recall(spark, rows)
    assert links > 1000 and met == links and same
    assert sum(compared) < 400 * 399 / 2 / 8


def test_text_ids_and_one_common_line(spark):
    line = prose(6000, 40)
    rows = [(k, line + "\n" + prose(6100 + k % 60, 5 + k % 7)) for k in range(240)]
    links, met, same = recall(spark, rows, text_ids=True)
    assert links and met == links and same


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
def test_measured_recall(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    links, met, same = recall(spark, list(zip(*(c.to_pylist() for c in table.columns))))
    assert links > 90 and met == links and same


def test_prefixes_share_an_element():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 99, near_dedup.COUNTERS)
    for _ in range(300):
        shared = rng.integers(1, 2**63, 40).astype(np.uint64)
        a, b = (np.concatenate([shared, rng.integers(1, 2**63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2))
        weights = [np.ones(len(a)), np.ones(len(b))]
        if 40 < 0.8 * (len(a) + len(b) - 40):
            continue
        (ea, _, wa), (eb, _, wb) = (near_dedup.prefixes(e, np.zeros(len(e), np.int64), w, counts) for e, w in zip((a, b), weights))
        both, at, bt = np.intersect1d(ea, eb, return_indices=True)
        least = 0.8 / 1.8 * (len(a) + len(b)) - 1e-6
        assert any(len(a) - wa[i] >= least and len(b) - wb[j] >= least for i, j in zip(at, bt))
