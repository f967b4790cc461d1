"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to three letters, words
padded by a blank) in the order of their counts over all training texts. A document's own most
frequent n-grams are compared with each profile: every n-gram costs the difference of its two
ranks, or the length of a profile if it isn't listed. The language of the least total is
predicted; ties go to the name that sorts first.

Defined cases: a null text or one without letters is `und` with score 0, and so is every text
if there are no training texts; null languages teach nothing; repeated rows count each time;
an empty table gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import once, slices, text_in, texts

# n-grams of a profile, of a language as well as of a document.
PROFILE = 300
# Distinct n-grams a training task holds before it hands on what it has counted.
HELD = 400_000
UNKNOWN = "und"
# Parts each language's counts are ranked in before the parts' best are ranked together.
RANKED_IN = 8

def _letter_table() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _is_letter() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return once("letters", _letter_table)


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers: up to three code points of 21 bits, a blank being 1."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[codes] if len(codes) else np.zeros(0, bool)
    codes = np.concatenate([[1], np.where(letter, codes, 1), [1]])
    codes = codes[(codes != 1) | np.concatenate([[True], codes[:-1] != 1])]  # one blank between words
    two = codes[:-1] | (codes[1:] << 21)
    three = two[:-1] | (codes[2:] << 42)
    # a lone blank, or one in the middle, tells nothing
    return np.concatenate([codes[codes != 1], two if len(codes) > 1 else two[:0], three[codes[1:-1] != 1]])


def top(text: str) -> np.ndarray:
    """A document's profile: its most frequent n-grams, ties in the order of their numbers."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))][:PROFILE]


def _counted(batches):
    """(lang, gram, n) of a task's texts."""
    held: dict[str, dict[int, int]] = {}

    def handed_on():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(counts)), pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        all_texts = texts(batch)
        for lang in dict.fromkeys(langs):
            grams, counts = np.unique(np.concatenate([ngrams(all_texts[i]) for i in np.flatnonzero(langs == lang)]), return_counts=True)
            mine = held.setdefault(lang, {})
            for g, n in zip(grams.tolist(), counts.tolist()):
                mine[g] = mine.get(g, 0) + n
        if sum(map(len, held.values())) > HELD:
            yield from handed_on()
    yield from handed_on()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Each language's profile, from all texts of the table that name a language. What comes
    to the driver is `PROFILE` numbers per language."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.col("n").desc(), F.col("gram")
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(RANKED_IN))).orderBy(*order)
    best = counts.withColumn("place", F.row_number().over(in_part)).filter(f"place <= {PROFILE}")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(f"rank <= {PROFILE}")
    profiles: dict[str, list[int]] = {}
    for lang, gram in ranked.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(lang, []).append(gram)
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


def distances(own: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Out-of-place distances per n-gram, as shares of the largest possible; a profile is
    (sorted n-grams, their ranks)."""
    out = []
    rank = np.arange(len(own))
    for grams, ranks in profiles:
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        out.append(np.where(grams[at] == own, np.abs(ranks[at] - rank), PROFILE).mean() / PROFILE)
    return np.array(out)


def _ranked(profiles: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each profile, by name, its n-grams in the order of their numbers, and their ranks."""
    orders = [(profiles[name], np.argsort(profiles[name], kind="stable")) for name in sorted(profiles)]
    return [(grams[order], order) for grams, order in orders]


def _identified(batches, profiles):
    names, ranked = sorted(profiles), _ranked(profiles)
    for batch in slices(batches):
        langs, scores = [], []
        for text in texts(batch):
            own = top(text)
            if not len(own) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            far = distances(own, ranked)
            langs.append(names[int(far.argmin())])
            scores.append(float(1 - far.min()))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(langs), pa.array(scores, pa.float64())], ["rest", "lang_pred", "score"])


def _with_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    rest = F.struct(*(keep or [docs[c] for c in docs.columns]))
    rows = docs.select(rest.alias("rest"), docs[text_col].cast("string").alias("text"))
    schema = rows.select("rest", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(partial(_identified, profiles=profiles), schema)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *keep: Column, text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row (all if none are named) with lang_pred and score; score
    is one minus the distance to the language predicted, as a share of the largest possible."""
    return _with_language(docs, profiles, text_col, keep).select("rest.*", "lang_pred", "score")


def _told(batches, profiles, at):
    """The rows in which some language is nearer than none."""
    ranked = _ranked(profiles)
    for batch in slices(text_in(b, "rest", at) for b in batches):
        own = map(top, texts(batch))
        keep = [len(o) > 0 and (not ranked or bool(distances(o, ranked).min() < 1)) for o in own]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["rest"])


def identified_only(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows in which a language was found, with the columns they came with: those without a
    letter go, and those of which no profile lists a single n-gram, as all languages are equally
    far then. Without profiles none can be told, and all rows with a letter stay."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"))
    return rows.mapInArrow(partial(_told, profiles=profiles, at=docs.columns.index(text_col)), rows.schema).select("rest.*")
