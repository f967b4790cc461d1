"""URL filters by Bloom filter cascades.

A rule is a host and a path. It fits the host itself and its subdomains where the URL's path
starts with the rule's; of all rules that fit the longest decides. So a URL asks for a few
keys, its host's suffixes each with the beginnings of its path as long as some rule's path,
and the first of them that is listed, longest first, names its rule.

Whether a key is listed is told by a cascade: level 0 is a Bloom filter of the listed keys,
level 1 one of the keys of the corpus that level 0 takes by mistake, level 2 one of the listed
keys that level 1 takes by mistake, and so on until no mistake is left. As all keys of the corpus
took part, the answer is exact for every one of them, and needs no join.

A cascade holds the listed keys that occur in the corpus. Where their bits would exceed
`MOST_BYTES`, the keys are split by a hash over several cascades of that size, which are asked
in turn: a task never holds more than one.

Defined cases: a null URL or one without `://` has an empty host and path and no rule; without
a rule the verdict is the filter's default; a key listed both ways is blocked; repeated
rows are decided row by row; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import math
from functools import partial
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored
from .words import U, mix

BITS_PER_KEY, HASHES = 10, 7
# Bits of the first level of a cascade, in bytes; further levels hold a small share of that.
MOST_BYTES = 32 << 20

_LEVEL, _GOLD = U(0xA24BAED4963EE407), U(0x9E3779B97F4A7C15)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without `://`. Only A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return (
        F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit("")),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """What a URL asks for, longest key first, of equals the one with the longer host first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(some, lambda n: F.struct(
        (-F.length(s) - n).alias("order"), (-F.length(s)).alias("host_order"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key"),
    ))))
    return F.when(host != "", F.transform(F.array_sort(pairs), lambda p: p.key)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """HASHES places in a filter of `size` bits for each of the (first, second) hashes."""
    first = mix(hashes[:, 0] + np.array([level], U) * _LEVEL)
    second = mix(hashes[:, 1] ^ (np.array([level], U) * _GOLD)) | U(1)
    return ((first[:, None] + np.arange(HASHES, dtype=U)[None, :] * second[:, None]) % U(size)).astype(np.int64)


def passes(hashes: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    at = _places(hashes, level, len(bits) * 64)
    return ((bits[at >> 6] >> (at & 63).astype(U)) & U(1)).all(axis=1)


def listed(hashes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Which keys a cascade holds. A key that a level refuses is what the level before holds."""
    out = np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    for level, bits in enumerate(levels):
        ok = passes(hashes[left], level, bits)
        out[left[~ok]] = level % 2 == 1
        left = left[ok]
    out[left] = len(levels) % 2 == 1
    return out


def _hash_columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(U) for c in ("h1", "h2")], axis=1)


def _bits(batches, level, words):
    """(word, bits) of a task's keys."""
    for batch in batches:
        at = _places(_hash_columns(batch), level, words * 64).ravel()
        order = np.argsort(at, kind="stable")
        at = np.unique(at[order])
        word, start = np.unique(at >> 6, return_index=True)
        value = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), start) if len(at) else np.zeros(0, U)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])


def _passing(batches, level, bits):
    for batch in batches:
        yield batch.filter(pa.array(passes(_hash_columns(batch), level, bits.value)))


def cascade(members: DataFrame, universe: DataFrame) -> list[np.ndarray]:
    """The levels of a cascade for `members`, some of the keys of `universe`; both are tables
    of distinct (key, h1, h2)."""
    context = members.sparkSession.sparkContext
    levels: list[np.ndarray] = []
    encode, other = members, None
    while True:
        count = encode.count()
        if not count and levels:
            return levels
        words = max(1, math.ceil(count * BITS_PER_KEY / 64))
        rows = encode.mapInArrow(partial(_bits, level=len(levels), words=words), "word long, bits long")
        bits = np.zeros(words, U)
        for word, value in rows.groupBy("word").agg(F.expr("bit_or(bits)")).toLocalIterator():
            bits[word] = U(value & 0xFFFFFFFFFFFFFFFF)
        levels.append(bits)
        taken = partial(_passing, level=len(levels) - 1, bits=context.broadcast(bits))
        if other is None:
            mistaken = universe.mapInArrow(taken, universe.schema).join(members.select("key"), "key", "left_anti")
        else:
            mistaken = other.mapInArrow(taken, other.schema)
        encode, other = stored(mistaken), encode


def _found(batches, name, levels):
    """Place of each row's first key that the cascade holds, unless an earlier place is known."""
    for batch in batches:
        asked = batch.column("asked")
        sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
        flat = asked.flatten()
        hashes = np.stack([flat.field(c).to_numpy().view(U) for c in ("h1", "h2")], axis=1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best = batch.column(name).to_numpy(zero_copy_only=False).copy()
        hit = listed(hashes, levels.value)
        np.minimum.at(best, row[hit], place[hit].astype(best.dtype))
        yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(best))


# Stands for no place.
_NONE = 1 << 30


def _hashed(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row per page: its id, host, path, rule (null without one) and verdict. `rules` has the
    columns rule (`host/path`) and verdict (allow or block)."""
    context = pages.sparkSession.sparkContext
    host, path = host_and_path(pages[url_col].cast("string"))
    parsed = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    lengths = [r[0] for r in rules.select(F.expr("length(rule) - instr(rule, '/') + 1")).distinct().collect()]  # of the paths in the list
    asked = parsed.withColumn("keys", keys(F.col("host"), F.col("path"), sorted(lengths)))
    universe = stored(asked.select(F.explode("keys").alias("key")).distinct().select("key", *_hashed("key")))
    rows = asked.withColumn("asked", F.transform("keys", lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(1)).alias("h2"))))
    for name in ("allow", "block"):
        own = rules.filter(F.col("verdict") == name).select(F.col("rule").alias("key")).distinct()
        present = stored(universe.join(own, "key", "left_semi"))
        parts = max(1, math.ceil(present.count() * BITS_PER_KEY / 8 / MOST_BYTES))
        rows = rows.withColumn(name, F.lit(_NONE))
        for part in range(parts):
            mine = F.pmod("h1", F.lit(parts)) == part
            # a part's cascade says no to all other keys of the corpus too
            levels = cascade(present.filter(mine), universe)
            rows = rows.mapInArrow(partial(_found, name=name, levels=context.broadcast(levels)), rows.schema)
    place = F.least("allow", "block")
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.when(place < _NONE, F.get("keys", place)).alias("rule"),
        F.when(place == _NONE, F.lit(default)).when(F.col("block") == place, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
