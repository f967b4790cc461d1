"""Near-duplicate classes by DartMinHash signatures and banded joins.

Each document is the weighted set of its five-word shingles (weights are counts; a text of one
to four words is one shingle). Similarity is the weighted Jaccard index: the sum of the smaller
weights over the sum of the larger ones. With `by_count=False` every distinct shingle weighs 1.
Documents of a similarity of `THRESHOLD` or more are linked, and linked documents form a class.

Signature: the weight axis of every element is cut into dyadic columns; darts arrive in each
column at random ranks, all drawn from hashes, so that equal regions receive equal darts in
every document. Those below an element's weight hit it; each dart belongs to one coordinate,
and the earliest hit of a coordinate is its value. Two documents agree in a coordinate with
a probability equal to their similarity. Only darts up to the rank at which all coordinates are
expected to be hit are thrown, and twice as far for documents that miss one.

Joins: texts with the same words are one node. Nodes that agree in all rows of a band share a
bucket. First each bucket's members are compared with its most central node (the one whose
buckets hold most), so a bucket of copies, however large, takes one comparison a member. Buckets
whose members are in one class by then are done. The members of the others are joined by a
prefix filter: a text's elements are put in one order for all texts, rare ones first, and two
texts of a similarity of `THRESHOLD` share one of those that make up the first fifth of their
weights. So texts that have a common passage and little else aren't met in pairs; nor are those
of one class. Pairs whose total weights or signatures differ too much are left out before texts
are joined; each comparison of the others is exact.

Defined cases: texts without words (null and empty ones too) are classes of their own; null
ids come last within a class; of repeated rows one stays; an empty table gives no rows; further
columns of the input are ignored.
"""
from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored
from .arrow import slices, text_in, texts
from .bits import bitmap, flagged
from .components import components
from .words import U, mix, words

SHINGLE = 5
THRESHOLD = 0.8
# A pair of similarity 0.8 shares no band with a probability of 0.0002.
BANDS, ROWS = 36, 7
COORDINATES = BANDS * ROWS
# Four bits of every coordinate are kept to tell far pairs from near ones. Of a pair of similarity
# 0.8 an expected 47 of them differ; more than 71 do with a probability of 0.0001.
KEPT_BITS = 4
PACKED, MOST_DIFFERENT = -(-COORDINATES // (64 // KEPT_BITS)), 71

# Bytes that a text counts for at least when slices are cut: a short one throws as many darts as
# a long one.
LEAST_BYTES = 2_000
# Counters of how many texts hold an element; those that fall together count as one.
COUNTERS = 1 << 18

_GOLD = U(0x9E3779B97F4A7C15)


def _thrown(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: np.ndarray, sig: np.ndarray) -> None:
    """Throw the darts of all elements up to their document's rank; keep the earliest per
    coordinate in `sig` (rank in the upper half of a value, the dart's name in the lower)."""
    columns = np.ceil(np.log2(weight + 1)).astype(np.int64)
    who = np.repeat(np.arange(len(element)), columns)
    level = np.arange(len(who)) - np.repeat(np.cumsum(columns) - columns, columns)
    seed = mix(element[who] + level.astype(U) * U(0xA24BAED4963EE407))
    width = np.ldexp(1.0, level)
    most, owner, top = reach[doc[who]], doc[who].astype(np.int64) * COORDINATES, weight[who]
    rank = np.zeros(len(who))
    drawn, block = 0, 1
    while len(who):
        # Arrival times of a Poisson process of the column's width: exponential gaps.
        names = mix(seed[:, None] + np.arange(drawn + 1, drawn + block + 1, dtype=U)[None, :] * _GOLD)
        gaps = -np.log(((names >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[:, None]
        ranks = np.cumsum(gaps, axis=1) + rank[:, None]
        hit = ranks < most[:, None]
        going = hit[:, -1].copy()
        if (top < 2 * width - 1).any():  # some elements end within their column
            more = mix(names + U(1))
            height = (width[:, None] - 1) + width[:, None] * ((more >> U(11)).astype(np.float64) * 2.0 ** -53)
            hit &= height < top[:, None]
        row, col = np.nonzero(hit)
        dart = mix(names[row, col] ^ U(0xC2B2AE3D27D4EB4F))
        value = (ranks[row, col].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (dart & U(0xFFFFFFFF))
        np.minimum.at(sig, owner[row] + ((dart >> U(32)) % U(COORDINATES)).astype(np.int64), value)
        rank = ranks[going, -1]
        seed, width, level, most, owner, top = (x[going] for x in (seed, width, level, most, owner, top))
        who = who[going]
        drawn, block = drawn + block, drawn + block


def weighted(hashes: np.ndarray, doc: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, document) with their weights."""
    key = mix(hashes + doc.astype(U) * U(0x9FB21C651E98DF25))
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    return hashes[at], doc[at], counts.astype(np.float64) if by_count else np.ones(len(at))


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """docs × COORDINATES values; rows of documents without elements stay at the maximum."""
    sig = np.full(docs * COORDINATES, np.iinfo(np.uint64).max, U)
    total = np.bincount(doc, weight, docs)
    darts = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
    reach = darts / np.maximum(total, 1e-300)
    left = np.ones(len(element), bool)
    while left.any():
        _thrown(element[left], weight[left], doc[left], reach, sig)
        open_ = (sig.reshape(docs, -1) == np.iinfo(np.uint64).max).any(axis=1)
        reach = reach * 2
        left = open_[doc]
    return sig.reshape(docs, COORDINATES)


SIGNED = "id {}, row_no long, node binary, total double, sig array<long>, bands array<long>"


def _signed(batches, by_count):
    for batch in slices(batches, least=LEAST_BYTES):
        found = words(texts(batch))
        hashes, doc, _ = found.shingles(SHINGLE)
        element, doc, weight = weighted(hashes, doc, by_count)
        n = batch.num_rows
        sig = signatures(element, doc, weight, n)
        some = np.diff(found.first) > 0
        names = found.whole()
        bands = np.zeros((n, BANDS), U)
        for j in range(ROWS):
            bands = mix(bands + sig[:, j::ROWS] + U(j))
        each = 64 // KEPT_BITS
        short = np.zeros((n, PACKED * each), U)
        short[:, :COORDINATES] = mix(sig) & U((1 << KEPT_BITS) - 1)
        short = (short.reshape(n, PACKED, each) << (U(KEPT_BITS) * np.arange(each, dtype=U))).sum(axis=2, dtype=U)
        node = pa.array([r.tobytes() if s else None for r, s in zip(names, some)], pa.binary())
        total = pa.array(np.bincount(doc, weight, n), mask=~some)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row_no"), node, total, _rows(short, some), _rows(bands, some)],
            ["id", "row_no", "node", "total", "sig", "bands"])


def _rows(values: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """Rows of numbers as lists, nulls where there is none."""
    offsets = np.concatenate([[0], np.cumsum(np.where(some, values.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[some].view(np.int64).ravel()), mask=pa.array(~some))


def _sides(batch: pa.RecordBatch, column: str, by_count: bool):
    found = words(texts(batch, column))
    hashes, doc, _ = found.shingles(SHINGLE)
    return weighted(hashes, doc, by_count), found.whole()


def _compared(batches, by_count):
    """(a, b) of the pairs of texts that are similar enough, and are the nodes they stand for."""
    for batch in slices(slices(batches, "a_text"), "b_text"):
        (e1, d1, w1), n1 = _sides(batch, "a_text", by_count)
        (e2, d2, w2), n2 = _sides(batch, "b_text", by_count)
        total = np.bincount(d1, w1, batch.num_rows) + np.bincount(d2, w2, batch.num_rows)
        k1, k2 = (mix(e + d.astype(U) * U(0x9FB21C651E98DF25)) for e, d in ((e1, d1), (e2, d2)))
        _, at1, at2 = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
        both = np.bincount(d1[at1], np.minimum(w1[at1], w2[at2]), batch.num_rows)
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = [i for i in np.flatnonzero(both >= THRESHOLD * (total - both) - 1e-9) if n1[i].tobytes() == a[i] and n2[i].tobytes() == b[i]]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _held(batches, by_count):
    """(slot, n): how many of the texts hold an element of the slot."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in slices(batches):
        (element, _, _), _ = _sides(batch, "text", by_count)
        counts += np.bincount(_slot(element), minlength=COUNTERS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["slot", "n"])


def _slot(element: np.ndarray) -> np.ndarray:
    return (mix(element) % U(COUNTERS)).astype(np.int64)


def prefixes(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, weight before it) of the elements that come first in the order of all
    texts, as long as what is left weighs enough for a similarity of THRESHOLD: two such texts
    share one of them."""
    order = np.lexsort((element, counts[_slot(element)], doc))
    element, doc, weight = element[order], doc[order], weight[order]
    sums = np.cumsum(weight)
    first = np.searchsorted(doc, doc)
    before = sums - weight - (sums[first] - weight[first])
    total = np.bincount(doc, weight)[doc] if len(doc) else weight
    keep = before <= (1 - THRESHOLD) * total + 1e-6
    return element[keep], doc[keep], before[keep]


def _first_elements(batches, counts, by_count):
    for batch in slices(batches):
        own, _ = _sides(batch, "text", by_count)
        element, doc, before = prefixes(*own, counts.value)
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        pairs = pa.StructArray.from_arrays([pa.array(element.view(np.int64)), pa.array(before)], ["element", "before"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "elements"])


def _balanced(a: str, b: str) -> str:
    """Whether two total weights allow a similarity of THRESHOLD."""
    return f"least({a}, {b}) >= {THRESHOLD}D * greatest({a}, {b}) - 1e-6D"


def _may_be_first() -> str:
    """Whether an element of both sides may be the first that they share: none before it is
    shared then, and what is left must weigh enough in both for the similarity."""
    least = f"{THRESHOLD / (1 + THRESHOLD)!r}D * (l.total + r.total) - 1e-6D"
    return f"l.total - l.before >= {least} AND r.total - r.before >= {least}"


def _close(a: str, b: str) -> str:
    """Whether at most MOST_DIFFERENT of two signatures' coordinates differ."""
    ones = sum(1 << at for at in range(0, 64, KEPT_BITS))

    def unlike(i: int) -> str:
        folded = " | ".join(f"shiftrightunsigned({a}[{i}] ^ {b}[{i}], {k})" for k in range(KEPT_BITS))
        return f"bit_count(({folded}) & {ones}L)"

    differing = " + ".join(map(unlike, range(PACKED)))
    return f"{differing} <= {MOST_DIFFERENT}"


class _Corpus:
    """What the rounds read again and again."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, by_count: bool):
        self.by_count = by_count
        self.docs = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
        signed = SIGNED.format(self.docs.schema["id"].dataType.simpleString())
        self.rows = stored(self.docs.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(partial(_signed, by_count=by_count), signed))
        worded = self.rows.filter("node IS NOT NULL")
        self.nodes = stored(worded.groupBy("node").agg(
            F.min("id").alias("id"), F.first("total").alias("total"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),
        ))
        in_band = self.nodes.select("node", "total", "sig", F.posexplode("bands").alias("band", "value")).select(
            "node", "total", "sig", F.xxhash64("band", "value").alias("bucket"))
        filled = stored(in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        # nearly all buckets hold one node: most of those are left out before the rest is shuffled
        bits = stored(bitmap(filled, F.col("bucket")))
        shared = stored(flagged(in_band, F.col("bucket"), bits, "met").filter("met").select("node", "total", "sig", "bucket").join(filled, "bucket"))
        # How central a node is: what near copies were made from meets more of them than they meet
        # of each other, so compared with it first they fall into one class.
        weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
        self.members = stored(shared.drop("n").join(weight, "node"))
        self._text: DataFrame | None = None

    def texts(self) -> DataFrame:
        """(node, text) of all nodes that share a bucket. Only rows whose id may be theirs are
        shuffled; a text of another node with the same id is told apart when it is compared."""
        if self._text is None:
            ids = stored(self.members.select("node").distinct().join(self.nodes.select("node", F.xxhash64("id").alias("key")), "node"))
            bits = stored(bitmap(ids, F.col("key")))
            found = flagged(self.docs.withColumn("key", F.xxhash64("id")), F.col("key"), bits, "asked").filter("asked").select("key", "text")
            # copies of a text are left out where they are; other texts of the same id stay
            once_each = found.join(ids, "key").groupBy("node", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
            self._text = stored(once_each.select("node", "text"))
        return self._text

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar enough, compared by their whole texts."""
        texts = self.texts()
        both = stored(pairs.distinct()).join(texts.toDF("b", "b_text"), "b").join(texts.toDF("a", "a_text"), "a")
        return both.select("a", "b", "a_text", "b_text").mapInArrow(partial(_compared, by_count=self.by_count), "a binary, b binary")

    def labels(self) -> DataFrame:
        """(node, label) of all nodes that have a link."""
        ordered = F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")
        top = self.members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "total", "sig")).alias("top")).select("bucket", "top.*")
        star = top.alias("l").join(self.members.alias("r"), F.expr(
            f"l.bucket = r.bucket AND l.node != r.node AND {_balanced('l.total', 'r.total')} AND {_close('l.sig', 'r.sig')}"))
        label = components(stored(self.similar(star.select(*ordered))))
        new = stored(self.similar(self.across(label)))
        # what is linked already counts as one node: only the new links are followed
        of_a, of_b = (label.toDF(c, f"{c}_label") for c in ("a", "b"))
        joint = new.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        further = components(stored(joint.filter("a != b"))).toDF("label", "lower")
        every = label.unionByName(further.select(F.col("label").alias("node"), "label").join(label, "node", "left_anti"))
        return every.join(further, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))

    def across(self, label: DataFrame) -> DataFrame:
        """(a, b) of nodes of different labels that share a prefix element, of all nodes of the
        buckets in which labels differ."""
        state = self.members.select("bucket", "node", "total").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
        rest = stored(state.join(mixed, "bucket").select("node", "total", "label").distinct())
        texts = stored(self.texts().join(rest.select("node"), "node", "left_semi"))
        slots = texts.mapInArrow(partial(_held, by_count=self.by_count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        counts = np.zeros(COUNTERS, np.int64)
        for slot, n in slots.toLocalIterator():  # COUNTERS rows at most
            counts[slot] = n
        sent = texts.sparkSession.sparkContext.broadcast(counts)
        first = texts.mapInArrow(partial(_first_elements, counts=sent, by_count=self.by_count), "node binary, elements array<struct<element: long, before: double>>")
        # a text of the wrong node with the same id may be there, too: all its pairs fail later
        held = stored(first.join(rest, "node").select("node", "label", "total", F.inline("elements")))
        labels = held.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n"))
        # pairs of one label aren't looked for: one of two nodes isn't of the commonest label
        common = labels.groupBy("element").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        met = stored(held.join(common.drop("labels"), "element"))
        pairs = met.filter("label != common").alias("l").join(met.alias("r"), F.expr(
            f"l.element = r.element AND l.label != r.label AND {_may_be_first()}"))
        once = stored(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct())
        sigs = self.nodes.select("node", "sig")
        return once.join(sigs.toDF("a", "a_sig"), "a").join(sigs.toDF("b", "b_sig"), "b").filter(F.expr(_close("a_sig", "b_sig"))).select("a", "b")

    def decisions(self) -> DataFrame:
        """id, row_no, node, class_id, class_size, kept for every row."""
        own = F.struct(F.isnull("id").alias("no_id"), "id", "row_no")
        per_node = self.rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first"))
        labelled = stored(per_node.join(self.labels(), "node", "left").select("node", "n", "first", F.coalesce("label", "node").alias("label")))
        classes = labelled.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("first").alias("first")).filter("class_size > 1")
        of_node = labelled.select("node", "label").join(classes, "label").drop("label")
        met = self.rows.drop("total", "sig", "bands").join(of_node, "node", "left")
        return met.select(
            "id", "row_no", "node", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            F.coalesce(F.col("row_no") == F.col("first.row_no"), F.lit(True)).alias("kept"),
        )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_count: bool = True) -> DataFrame:
    """A row per document: its id, class_id (the least id of its class), class_size, kept."""
    return _Corpus(docs, id_col, text_col, by_count).decisions().select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def _named(batches, at):
    for batch in slices(text_in(b, "rest", at) for b in batches):
        found = words(texts(batch))
        names = [r.tobytes() if s else None for r, s in zip(found.whole(), np.diff(found.first) > 0)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "rest")), pa.array(names, pa.binary())], ["id", "key", "rest", "node"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_count: bool = True) -> DataFrame:
    """The documents that stay, one of each class, with all their columns. Only rows that may
    be dropped are shuffled."""
    made = stored(_Corpus(docs, id_col, text_col, by_count).decisions())
    key = F.xxhash64("id")
    dropped = made.filter("NOT kept").select(key.alias("key")).distinct()
    bits = stored(bitmap(dropped, F.col("key")))
    rows = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("rest"))
    marked = flagged(rows.withColumn("key", key), F.col("key"), bits, "suspect")
    suspect = marked.filter("suspect").select("id", "key", "rest")
    schema = suspect.select("id", "key", "rest", F.lit(None).cast("binary").alias("node")).schema
    # both branches go by the node: whether a text has words is told in one place only
    named = suspect.mapInArrow(partial(_named, at=docs.columns.index(text_col)), schema)
    none = named.filter("node IS NULL").select("rest")
    known = made.withColumn("key", key).join(dropped, "key").groupBy("key", "node").agg(F.max("kept").alias("stays"))
    met = named.filter("node IS NOT NULL").join(known, ["key", "node"], "left")
    strange = met.filter("stays IS NULL").select("rest")
    # repeated rows of a document that stays: one is left
    keepers = met.filter("stays").groupBy("key", "node").agg(F.first("rest").alias("rest")).select("rest")
    return marked.filter("NOT suspect").select("rest").unionByName(strange).unionByName(keepers).unionByName(none).select("rest.*")
