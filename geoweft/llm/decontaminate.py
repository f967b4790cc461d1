"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words. Runs of `SEED` words of the benchmark's items are seeds; joining
them with the documents' runs gives the pairs of a document and an item that share any. Each
pair is tiled: running Karp-Rabin finds the longest matches between words that no tile covers
yet, they are laid as tiles, and so on with ever shorter matches down to `SEED` words. As tiles
may lie in any order, passages that were cut up and reordered are caught. A document is
contaminated by an item if tiles cover at least `COVERAGE` of the item's words.

Seeds of the benchmark are sent to the tasks in blocks of bounded size, so a document is read
once for each block and never shuffled, however often its passages occur.

Defined cases: null texts count as empty and match nothing; items shorter than a seed match as
a whole run of their words; of repeated items each is reported; an empty table gives no rows;
further columns of the input are ignored.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import slices, text_in, texts
from .words import U, mix, powers, words

SEED = 5
COVERAGE = 0.5
# Benchmark items whose seeds are sent to the tasks at once, and the most words they may have.
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000

_PAIR = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_PAIR), -1, 2**64))  # odd numbers have one


class _Rolling:
    """Hashes of all runs of any length, each from two prefix sums of a polynomial in the words:
    a longer run costs no more than a short one."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(tokens * powers(_PAIR, n)[:n], dtype=U)])
        self.back = powers(_INVERSE, n)[:n]  # shifts a run to the polynomial's lowest power

    def runs(self, size: int) -> np.ndarray:
        n = max(0, len(self.back) - size + 1)
        return (self.sums[size:size + n] - self.sums[:n]) * self.back[:n]


def _runs(rolling: _Rolling, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` free words, and where they begin."""
    n = len(free) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:n])
    return mix(rolling.runs(size)[at]), at


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the text, length), longest matches first."""
    free_i, free_t = np.ones(len(item), bool), text != 0  # 0 marks a break between segments
    rolling_i, rolling_t = _Rolling(item), _Rolling(text)
    laid: list[tuple[int, int, int]] = []
    size = len(item)
    while size >= least:
        h_i, at_i = _runs(rolling_i, free_i, size)
        h_t, at_t = _runs(rolling_t, free_t, size)
        placed = False
        if len(h_i) and len(h_t):
            order = np.argsort(h_t, kind="stable")
            low = np.searchsorted(h_t[order], h_i, "left")
            high = np.searchsorted(h_t[order], h_i, "right")
            for k in np.flatnonzero(high > low):
                i = int(at_i[k])
                if not free_i[i:i + size].all():
                    continue
                for t in at_t[order[low[k]:high[k]]]:
                    if free_t[t:t + size].all() and (item[i:i + size] == text[t:t + size]).all():
                        free_i[i:i + size] = free_t[t:t + size] = False
                        laid.append((i, int(t), size))
                        placed = True
                        break
        # runs of this length are used up; the next shorter ones follow
        size = size - 1 if placed or size <= 2 * least else max(least, size // 2) if not _any_longer(rolling_i, rolling_t, free_i, free_t, max(least, size // 2)) else size - 1
    return laid


def _any_longer(rolling_i, rolling_t, free_i, free_t, size) -> bool:
    """Whether some match has `size` words or more; if none has, lengths down to it are skipped."""
    return bool(np.isin(_runs(rolling_i, free_i, size)[0], _runs(rolling_t, free_t, size)[0]).any())


class _Block:
    """A block of items ready for looking up seeds."""

    def __init__(self, ids: list, item_texts: list[str]):
        found = words(item_texts)
        self.ids = ids
        self.tokens = [found.hashes[a:b] for a, b in zip(found.first, found.first[1:])]
        # an item shorter than a seed is a single run of its own length
        self.seeds = []
        for size in sorted({min(SEED, len(t)) for t in self.tokens if len(t)}):
            pairs = [(h, k) for k, t in enumerate(self.tokens) if min(SEED, len(t)) == size for h in mix(_Rolling(t).runs(size)).tolist()]
            pairs = sorted(set(pairs))
            self.seeds.append((size, np.array([h for h, _ in pairs], U), np.array([k for _, k in pairs], np.int64)))

    def found_in(self, hashes: np.ndarray, doc: np.ndarray):
        """(text, item, places of their shared runs, length of a run) of every pair that shares any."""
        rolling = _Rolling(hashes)
        for size, seeds, items in self.seeds:
            n = len(hashes) - size + 1
            if n <= 0:
                continue
            run = mix(rolling.runs(size))
            low = np.searchsorted(seeds, run)
            hit = (seeds[np.minimum(low, len(seeds) - 1)] == run) & (doc[:n] == doc[size - 1:])
            at = np.flatnonzero(hit)
            count = np.searchsorted(seeds, run[at], "right") - low[at]
            place = np.repeat(at, count)
            item = items[np.repeat(low[at], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)]
            order = np.lexsort((place, item, doc[place]))
            place, item = place[order], item[order]
            edges = np.flatnonzero(np.diff(doc[place]) | np.diff(item)) + 1
            for p, k in zip(np.split(place, edges), np.split(item, edges)):
                if len(p):
                    yield int(doc[p[0]]), int(k[0]), p, size


def _covered(block: _Block, item: int, hashes: np.ndarray, places: np.ndarray, size: int) -> tuple[float, int]:
    """Share of an item's words that tiles cover, and their number. Only words in shared runs
    can lie in a tile: the rest of the text is left out."""
    inside = np.unique((places[:, None] + np.arange(size)[None, :]).ravel())
    breaks = np.flatnonzero(np.diff(inside) > 1) + 1
    text = np.insert(hashes[inside], breaks, U(0))
    tokens = block.tokens[item]
    laid = tiles(tokens, text, size)
    return sum(length for _, _, length in laid) / len(tokens), len(laid)


def _matches(batches, block, coverage, item_type):
    known = _Block(*block.value)
    for batch in slices(batches):
        found = words(texts(batch))
        rows, items, shares, numbers = [], [], [], []
        for doc, item, places, size in known.found_in(found.hashes, found.doc):
            share, number = _covered(known, item, found.hashes, places, size)
            if share >= coverage:
                rows.append(doc)
                items.append(known.ids[item])
                shares.append(share)
                numbers.append(number)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(shares, pa.float64()), pa.array(numbers, pa.int32())],
            ["id", "item_id", "coverage", "tiles"])


def _clean(batches, block, coverage, at):
    known = _Block(*block.value)
    for batch in slices(text_in(b, "rest", at) for b in batches):
        found = words(texts(batch))
        bad = set()
        for doc, item, places, size in known.found_in(found.hashes, found.doc):
            if doc not in bad and _covered(known, item, found.hashes, places, size)[0] >= coverage:
                bad.add(doc)
        keep = [i for i in range(batch.num_rows) if i not in bad]
        yield batch.take(pa.array(keep, pa.int64())).select(["rest"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in blocks of bounded numbers of items and words."""
    ids: list = []
    item_texts: list[str] = []
    total = 0
    rows = benchmark.select(benchmark[item_col].alias("id"), benchmark[text_col].cast("string").alias("text")).filter("text IS NOT NULL")
    for row in rows.withColumn("words", F.regexp_count("text", F.lit(r"(?U)\w+"))).toLocalIterator():
        size = row.words
        if ids and (len(ids) >= BLOCK_ITEMS or total + size > BLOCK_WORDS):
            yield ids, item_texts
            ids, item_texts, total = [], [], 0
        ids.append(row.id)
        item_texts.append(row.text)
        total += size
    if ids:
        yield ids, item_texts


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row per document and item that contaminates it: their ids, the share of the item's
    words that tiles cover, and the number of tiles."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {kind}, item_id {item_type.simpleString()}, coverage double, tiles int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.unionByName(rows.mapInArrow(partial(_matches, block=sent, coverage=coverage, item_type=to_arrow_type(item_type)), schema))
    return out.withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"))
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(partial(_clean, block=sent, coverage=coverage, at=at), rows.schema)
    return rows.select("rest.*")
