"""The registered queries: each applies its operator to its whole table and derives the
columns of its contract from what the operator returns."""
from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, fill_in_middle, language, licenses, near_dedup, quality, secrets, sharding, url_filter, whitening
from .arrow import once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL equivalent where there is one."""
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The rules of the specification.
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


@query(r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.*, r.rule, r.verdict FROM parts p LEFT JOIN rules r
  ON ends_with('.' || p.host, '.' || split_part(r.rule, '/', 1)) AND starts_with(p.path, substring(r.rule, position('/' IN r.rule))))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
""")
def op1_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.filter_urls(table(spark, sf, "pages"), rules)


@query()
def op4_sharding(spark, sf):
    shards = sharding.shard_by_bytes(table(spark, sf, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""")
def op5_exact_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    return exact_dedup.exact_dedup(docs.withColumn("text_sha256", digest), carry=("text_sha256",))


@query()
def op9_secrets(spark, sf):
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(table(spark, sf, "documents")).withColumn("text_spans", spans).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2("text_spans", 256).alias("base_sha256"), F.col("text_spans").alias("spans"),
    )


def _remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


@query()
def op2_decontamination(spark, sf):
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query()
def op3_near_dedup(spark, sf):
    return near_dedup.near_dedup(table(spark, sf, "documents"))


@query()
def op6_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    rest = _remainder("doc_id", 4)
    profiles = language.train(docs.filter(rest != 2))
    return language.identify(docs, profiles, F.col("doc_id"), (rest == 2).alias("held_out"))


def _digests(batches, ranks, name):
    """doc_id, number and digest of the ids, and the bytes they stand for."""
    pieces = once(name, lambda: bpe.byte_table(ranks.value))
    for batch in bpe.id_slices(batches):
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        digests = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:])]
        back = [hashlib.sha256(b).hexdigest() for b in bpe.decoded(lists, *pieces)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(digests), pa.array(back)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded_and_decoded(docs):
    """Token counts and digests of all texts, by the multilingual vocabulary."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    name = f"bytes {hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()}"
    return bpe.encode(
        docs, ranks, public_tokenizers.PATTERN, then=partial(_digests, ranks=sent, name=name),
        then_schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query()
def op7_bpe(spark, sf):
    return encoded_and_decoded(table(spark, sf, "documents"))


@query()
def op8_quality(spark, sf):
    docs = table(spark, sf, "documents")
    rest = _remainder("doc_id", 5)
    model = quality.train(docs, table(spark, sf, "labels"), "quality", rest != 0)
    scored = quality.score(docs, model, F.col("doc_id"), (rest == 0).alias("held_out"))
    return scored.withColumn("predicted", F.expr("CAST(score >= 0.3 AS INT)"))


COUNTED = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _conversations(batches):
    """Counts and digests of every conversation. Its windows come one after the other in their
    order; of those before the batch only the counts and the state of the digests are kept."""
    open_ = kind = None
    done: list[tuple] = []

    def ended(conv, n_turns, turns, loss_chars, loss, chars):
        return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def handed_on():
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(values, k) for values, k in zip(zip(*done), kinds)], COUNTED)
        done.clear()
        return out

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turns, n_turns, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "n_turns", "loss", "chars"))):
            if open_ is None or open_[0] != conv:
                if open_ is not None:
                    done.append(ended(*open_))
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_[1] += n_turns
            open_[2].update(turns.encode())
            open_[3] += len(loss)
            open_[4].update(loss.encode())
            open_[5] += chars
        if done:
            yield handed_on()
    if open_ is not None:
        done.append(ended(*open_))
        yield handed_on()


@query()
def op10_chat(spark, sf):
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.windows(turns))
    # a digest over a whole conversation takes its windows in order, in one task
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = read.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        _conversations, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query()
def op11_whitening(spark, sf):
    rows = whitening.whiten(table(spark, sf, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query()
def op12_licenses(spark, sf):
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return licenses.scan(table(spark, sf, "documents")).withColumns(joined)


@query()
def op13_fill_in_middle(spark, sf):
    return fill_in_middle.digests(table(spark, sf, "documents"))
