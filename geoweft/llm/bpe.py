"""Byte-level BPE over overlapping chunks.

A long text is cut into windows that overlap. Every window is split into pre-tokens on its own,
in whatever task it lands. Two neighbours are stitched at the first place in their overlap
where both have a pre-token boundary: from there on both split alike, and up to there the left
one has seen all that its pre-tokens depend on. Each side keeps the ids of its own pieces.
Where no such place exists (one pre-token covers the whole overlap) the two windows are joined
and split again. Texts of one window never leave their task.

Defined cases: a null text counts as empty and has no ids; repeated rows and ids are encoded
row by row; an empty table gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import once, slices, texts

# Characters of a window, and those it shares with the next one.
CHUNK, OVERLAP = 16_384, 512
# Pre-tokens whose ids a process remembers before it forgets them all.
REMEMBERED = 50_000
# Between these two, texts are cut in the same place however they are split.
SAFE_CUT = r"\S\s"
# The rank of a pair that is never merged.
NEVER = 1 << 60
# Bytes up to which pre-tokens are merged together with others, and pairs simply searched.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte sequences of a rank file (one `base64 rank` a line) with their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of all neighbouring parts the pair of the lowest rank is merged,
    the leftmost first, until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merged_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    rank = ranks.get
    pairs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < NEVER:
        i = pairs.index(least)
        parts[i] = joint = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] + joint, NEVER)
        if i < len(pairs):
            pairs[i] = rank(joint + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for runs of any length."""
    n = len(piece)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < n and (rank := ranks.get(piece[i:ends[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, ends[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]


class Pairs:
    """Ranks of all pairs of ids that may be merged, looked up by the thousand."""

    def __init__(self, ranks: dict[bytes, int]):
        joint = [
            (left << 32 | right, rank) for piece, rank in ranks.items() for i in range(1, len(piece))
            if (left := ranks.get(piece[:i])) is not None and (right := ranks.get(piece[i:])) is not None
        ]
        joint.sort()
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*joint)) if joint else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)


def merged_together(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """What `merged` gives, packed, for many short pre-tokens at once: in every round each of
    them merges its next pair, and those without one are done."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    token = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    last = np.append(owner[1:] != owner[:-1], True)
    rank = np.where(last, NEVER, pairs.of(token, np.append(token[1:], 0)))
    while len(token):
        starts = np.flatnonzero(np.append(True, last[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        least = np.minimum.reduceat(rank, starts)
        going = np.repeat(least < NEVER, sizes)
        if not going.all():
            done.append((owner[~going], token[~going]))
            least, sizes = least[least < NEVER], sizes[least < NEVER]
            token, owner, last, rank = token[going], owner[going], last[going], rank[going]
            if not len(token):
                break
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])]  # the leftmost of each
        token[at], last[at] = rank[at], last[at + 1]
        stays = np.ones(len(token), bool)
        stays[at + 1] = False
        at = at - np.arange(len(at))  # where the merged ids are once the others are gone
        token, owner, last, rank = token[stays], owner[stays], last[stays], rank[stays]
        for changed in (at, at[(at > 0) & (owner[np.maximum(at - 1, 0)] == owner[at])] - 1):
            after = np.minimum(changed + 1, len(token) - 1)
            rank[changed] = np.where(last[changed], NEVER, pairs.of(token[changed], token[after]))
    owner, token = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owner, kind="stable")
    packed = token[order].astype("<u4").tobytes()
    ends = 4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Splits texts and keeps the packed ids (unsigned, 32 bits, little-endian) of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.pairs = ranks, regex.compile(pattern).findall, Pairs(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, all_texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """Of each text its pre-tokens and their ids."""
        found = list(map(self.split, all_texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [(p, p.encode()) for p in set().union(*found).difference(self.known)]
        rest = []
        for piece, raw in new:
            if len(raw) > SHORT or raw in self.ranks:
                self.known[piece] = np.array(merged(raw, self.ranks), "<u4").tobytes()
            else:
                rest.append((piece, raw))
        self.known.update(zip((p for p, _ in rest), merged_together([raw for _, raw in rest], self.pairs)))
        get = self.known.__getitem__
        return [(pieces, list(map(get, pieces))) for pieces in found]

    def pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        return self.encode([text])[0]


def _lists(packed: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(packed), "<i4")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in packed)]), pa.int32()), pa.array(flat))


def _encode_whole(batches, ranks, pattern, name):
    encoder = once(name, lambda: Encoder(ranks.value, pattern))
    for batch in slices(batches):
        ids = [b"".join(ids) for _, ids in encoder.encode(texts(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(ids)], ["id", "ids"])


def _windows(batches, chunk, overlap):
    for batch in slices(batches):
        for key, row, text in zip(batch.column("id"), batch.column("row"), texts(batch)):
            cuts = [text[at:at + chunk + overlap] for at in range(0, len(text), chunk)]
            n = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(key, n), pa.repeat(row, n), pa.array(range(n), pa.int32()), pa.array(cuts)], ["id", "row", "no", "text"])


def _encode_windows(batches, ranks, pattern, name, chunk, overlap, safe):
    """Of each window its ids, and the pieces' ends (in characters, from its start) and numbers
    of ids before them where it overlaps others. The text goes along where a stitch may fail."""
    encoder = once(name, lambda: Encoder(ranks.value, pattern))
    cut = regex.compile(safe) if safe else None
    for batch in slices(batches):
        columns = ends, counts, packed, sizes, kept = [], [], [], [], []
        all_texts = texts(batch)
        for text, (found, ids) in zip(all_texts, encoder.encode(all_texts)):
            end = np.cumsum([len(p) for p in found], dtype=np.int32)
            count = np.cumsum([len(i) // 4 for i in ids], dtype=np.int32)
            shared = (end <= overlap) | (end >= chunk)
            ends.append(end[shared])
            counts.append(count[shared])
            packed.append(b"".join(ids))
            sizes.append(len(text))
            sure = cut and all(not zone or cut.search(zone) for zone in (text[:overlap], text[chunk:chunk + overlap]))
            kept.append(None if sure else text)
        kinds = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.string()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "row", "no")), *(pa.array(x, k) for x, k in zip(columns, kinds))],
            ["id", "row", "no", "ends", "counts", "packed", "size", "text"])


def stitched(windows: list[tuple[str | None, int, np.ndarray, np.ndarray, bytes]], encoder: Encoder, chunk: int) -> bytes:
    """Packed ids of the text whose windows these are: (text if it may be needed, its length,
    piece ends, id ends, ids)."""
    out: list[bytes] = []
    text, size, ends, counts, packed = windows[0]
    begin, cut = 0, 0  # of the current window: its place in the text, and where its own pieces begin

    def kept(upto: int | None) -> bytes:
        """Ids of the current window's pieces from `cut` to `upto` (places in the text)."""
        lo = counts[np.searchsorted(ends, cut - begin)] if cut > begin else 0
        hi = len(packed) // 4 if upto is None else (counts[np.searchsorted(ends, upto - begin)] if upto > begin else 0)
        return packed[4 * lo:4 * hi]

    for no, following in enumerate(windows[1:], 1):
        start = no * chunk
        mine = ends + begin
        mine = mine[(mine >= max(start, cut)) & (mine < begin + size)]
        theirs = np.concatenate([[0], following[2]]) + start
        common = np.intersect1d(mine, theirs)
        if len(common):
            out.append(kept(int(common[0])))
            cut, begin = int(common[0]), start
            text, size, ends, counts, packed = following
        else:  # split both again as one window
            text = text[cut - begin:start - begin] + following[0]
            begin, size = cut, len(text)
            found, ids = encoder.pieces(text)
            ends, counts = np.cumsum([len(p) for p in found]), np.cumsum([len(i) // 4 for i in ids])
            packed = b"".join(ids)
    return b"".join([*out, kept(None)])


def _stitch(table: pa.Table, ranks, pattern, name, chunk) -> pa.Table:
    rows = table.sort_by("no")
    columns = (rows.column(c).to_pylist() for c in ("text", "size", "ends", "counts", "packed"))
    windows = [(t, n, np.array(e, np.int64), np.array(c, np.int64), p) for t, n, e, c, p in zip(*columns)]
    ids = stitched(windows, once(name, lambda: Encoder(ranks.value, pattern)), chunk)
    return pa.table({"id": rows.column("id").combine_chunks()[:1], "ids": _lists([ids])})


def _whole(batches, encoded, then):
    yield from then(encoded(batches))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP, safe: str | None = SAFE_CUT, then=None, then_schema: str = "") -> DataFrame:
    """A row per document: its id and `ids`, an array of token ids. `safe` finds two characters
    between which the pattern always cuts (None if it has no such place). With `then`, the rows
    that it makes (of `then_schema`) of batches of ids: in the process that encodes, as a second
    one for each task would need as much memory again."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size is the file's
    name = f"bpe {hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()}"
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    key = rows.schema["id"].dataType.simpleString()
    schema = then_schema if then else f"id {key}, ids array<int>"
    long = F.char_length("text") > chunk + overlap
    encoded = partial(_encode_whole, ranks=sent, pattern=pattern, name=name)
    short = rows.filter(~long).mapInArrow(partial(_whole, encoded=encoded, then=then) if then else encoded, schema)
    windows = rows.withColumn("row", F.monotonically_increasing_id()).filter(long).mapInArrow(
        partial(_windows, chunk=chunk, overlap=overlap), f"id {key}, row long, no int, text string",
    )
    # the windows of one text go to as many tasks as there are
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = windows.repartition(parts, "row", "no").mapInArrow(
        partial(_encode_windows, ranks=sent, pattern=pattern, name=name, chunk=chunk, overlap=overlap, safe=safe),
        f"id {key}, row long, no int, ends array<int>, counts array<int>, packed binary, size int, text string",
    )
    def stitch(table: pa.Table) -> pa.Table:
        ids = _stitch(table, sent, pattern, name, chunk)
        return pa.Table.from_batches(then(ids.to_batches())) if then else ids

    out = short.unionByName(split.groupBy("row").applyInArrow(stitch, schema))
    return out if then else out.withColumnRenamed("id", id_col)


def decoded(lists: pa.ListArray, pieces: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids: every id's bytes, one after the other."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = starts[flat + 1] - starts[flat]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[flat] - (ends - sizes), sizes)
    blob = pieces[at].tobytes()
    cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) if x is not None else 0 for x in lists)])]
    return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All ids' bytes in one array, and where each begins."""
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum([0, *map(len, by_id)])


# Ids of a slice while lists are decoded.
SLICE_IDS = 400_000


def id_slices(batches):
    for batch in batches:
        sizes = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SLICE_IDS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _decode(batches, ranks):
    table = byte_table(ranks.value)
    for batch in id_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decoded(batch.column("ids"), *table), pa.binary())], ["id", "decoded"])


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """A row per row of `encode`: its id and `decoded`, the bytes its ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select(encoded[id_col].alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_decode, ranks=sent), f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
