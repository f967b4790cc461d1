"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a
shunting-yard parser evaluates the expressions behind the tags.

Texts are lower-cased (A to Z) and cut into words: runs of ASCII letters, digits and any
character beyond ASCII. The automaton runs over the words, separated by single blanks, and finds
every place of every phrase, overlapping ones too. Behind `SPDX-License-Identifier:` an
expression of identifiers, `and`, `or`, `with` and brackets is read to the end of its line, or
to the first token that can't continue it. Evaluated, it tells how much it binds: `or` lets
the reader choose (the lesser), `and` binds to both (the greater), an exception after `with`
softens a copyleft license by a class.

A document's score is how much the most binding of its statements binds: 0 for none, 0.25
permissive, 0.5 weak copyleft or unknown identifiers, 0.75 copyleft, 1 all rights reserved or
terms that exclude uses.

Defined cases: null and empty texts have no words, no places and score 0; a text of any length
is read in windows, a phrase or tag across their border is found; an expression that is broken
(a bracket or operand missing) binds like all its identifiers together; repeated rows and null
ids are rows like others; an empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import once, slices

# ---- fixed values: the phrases of the specification, with their labels ----
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# --------------------------------------------------------------------------

PERMISSIVE, WEAK, COPYLEFT, CLOSED = 0.25, 0.5, 0.75, 1.0

# ---- fixed values: further notice phrases, their labels and how much each binds ----
NOTICES = (
    ("mit license", "mit", PERMISSIVE), ("permission is hereby granted free of charge", "mit", PERMISSIVE),
    ("apache license", "apache", PERMISSIVE), ("bsd license", "bsd", PERMISSIVE),
    ("redistribution and use in source and binary forms", "bsd", PERMISSIVE), ("isc license", "isc", PERMISSIVE),
    ("boost software license", "bsl", PERMISSIVE), ("public domain", "public-domain", PERMISSIVE), ("cc0", "cc0", PERMISSIVE),
    ("cc by sa", "cc-by-sa", COPYLEFT), ("cc by nc", "cc-by-nc", CLOSED), ("cc by nd", "cc-by-nd", CLOSED),
    ("creative commons attribution", "cc-by", PERMISSIVE), ("mozilla public license", "mpl", WEAK),
    ("eclipse public license", "epl", WEAK), ("lesser general public license", "lgpl", WEAK),
    ("library general public license", "lgpl", WEAK), ("affero general public license", "agpl", COPYLEFT),
    ("european union public licence", "eupl", COPYLEFT), ("proprietary and confidential", "proprietary", CLOSED),
)
BINDS = {"cc-by": PERMISSIVE, "gpl": COPYLEFT, "reserved": CLOSED}
TAG = "spdx license identifier"
# Identifiers by how they begin; the first that fits counts.
FAMILIES = (
    ("agpl", "agpl", COPYLEFT), ("lgpl", "lgpl", WEAK), ("gpl", "gpl", COPYLEFT), ("mpl", "mpl", WEAK), ("epl", "epl", WEAK), ("cddl", "cddl", WEAK),
    ("eupl", "eupl", COPYLEFT), ("mit", "mit", PERMISSIVE), ("apache", "apache", PERMISSIVE), ("bsd", "bsd", PERMISSIVE), ("isc", "isc", PERMISSIVE),
    ("bsl", "bsl", PERMISSIVE), ("zlib", "zlib", PERMISSIVE), ("unlicense", "public-domain", PERMISSIVE), ("cc0", "cc0", PERMISSIVE),
    ("cc-by-sa", "cc-by-sa", COPYLEFT), ("cc-by-nc", "cc-by-nc", CLOSED), ("cc-by-nd", "cc-by-nd", CLOSED), ("cc-by", "cc-by", PERMISSIVE),
)
# -------------------------------------------------------------------------------------

# Bytes of a text that are read at a time.
WINDOW = 1_000_000

_BLANK = 32


# ---- expressions ---------------------------------------------------------------

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_COLON = re.compile(rb"[ \t]*:")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, float]:
    """Label of an identifier, and how much its license binds."""
    for begins, label, binds in FAMILIES:
        if identifier.startswith(begins):
            return label, binds
    return identifier, WEAK


def tokens(line: bytes, start: int = 0) -> list[str]:
    """The longest run of tokens that can be (the beginning of) an expression."""
    out: list[str] = []
    depth, operand = 0, True  # whether an operand is due
    while m := _TOKEN.match(line, start):
        token = m[1].decode("ascii").lower()
        if operand:
            if token in _RANK or token == ")":
                break
            depth, operand = (depth + 1, True) if token == "(" else (depth, False)
        elif token == ")" and depth:
            depth -= 1
        elif token in _RANK:
            operand = True
        else:
            break
        out.append(token)
        start = m.end()
    return out


def _applied(operator: str, left: float, right: float) -> float:
    if operator == "or":
        return min(left, right)
    if operator == "and":
        return max(left, right)
    return max(PERMISSIVE, left - 0.25) if left in (WEAK, COPYLEFT) else left


def evaluate(expression: list[str]) -> tuple[set[str], float]:
    """Labels of an expression's licenses and how much it binds, by a shunting yard."""
    labels: set[str] = set()
    values: list[float] = []
    operators: list[str] = []
    alone: list[float] = []

    def reduce_() -> None:
        right, left = values.pop(), values.pop()
        values.append(_applied(operators.pop(), left, right))

    whole = True
    exception = False
    for token in expression:
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                reduce_()
            operators.pop()
        elif token in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[token]:
                reduce_()
            operators.append(token)
            exception = token == "with"
        else:
            # an exception is no license: it has no label and binds nobody
            label, binds = family(token)
            if not exception:
                labels.add(label)
                alone.append(binds)
            exception = False
            values.append(binds)
    while operators and whole:
        if operators[-1] == "(" or len(values) < 2:
            whole = False
        else:
            reduce_()
    if not whole or len(values) != 1:
        return labels, max(alone, default=0.0)
    return labels, values[0]


# ---- words and phrases -----------------------------------------------------------

def _table() -> np.ndarray:
    """Bytes as words hold them: lower case, or a blank where a word can't hold them."""
    at = np.arange(256, dtype=np.uint8)
    low = np.where((at >= 65) & (at <= 90), at + 32, at).astype(np.uint8)
    held = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    return np.where(held, low, _BLANK).astype(np.uint8)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    labels: dict[str, list] = {}
    for phrase, label in BASE:
        labels.setdefault(phrase, []).append((label, True, BINDS[label]))
    for phrase, label, binds in NOTICES:
        labels.setdefault(phrase, []).append((label, False, binds))
    labels.setdefault(TAG, []).append((None, False, 0.0))
    for phrase, own in labels.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, own))
    found.make_automaton()
    return found


MOST_WORDS = max(len(p.split()) for p in [TAG, *(p for p, *_ in BASE), *(p for p, *_ in NOTICES)])


@dataclass
class Found:
    """What a text holds."""
    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    score: float = 0.0

    def places(self, word: int, after: int, kinds: list, rest) -> None:
        """A phrase's place: its first word; `after` is where the raw text goes on behind it."""
        for label, base, binds in kinds:
            if label is None:
                m = _COLON.match(rest, after)
                if not m:
                    continue
                named, binds = evaluate(tokens(rest, m.end()))
                self.labels |= named
            else:
                self.labels.add(label)
                if base:
                    self.n_base += 1
                    self.base_labels.add(label)
                    self.first_word = word if self.first_word is None else min(self.first_word, word)
                    self.last_word = word if self.last_word is None else max(self.last_word, word)
            self.score = max(self.score, binds)


def _normalised(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one blank before and behind each, and where each byte was in the raw text."""
    low = table[raw]
    blank = low == _BLANK
    keep = np.flatnonzero(~(blank & np.concatenate([[False], blank[:-1]])))
    return low[keep], keep


def scan_text(text: bytes) -> Found:
    """The phrases and tags of one text, read in windows: the last words of each are read
    again with the next, so that no phrase is cut."""
    table, automaton = once("license bytes", _table), once("license phrases", _automaton)
    found = Found()
    size, start, done = len(text), 0, 0
    raw = np.frombuffer(text, np.uint8)
    blanks = table == _BLANK
    while start < size:
        stop = min(size, start + WINDOW)
        while True:
            # a blank in front (a window begins with a word or the text) and one behind
            body, where = _normalised(raw[start:stop], table)
            gaps = np.flatnonzero(body == _BLANK)
            if stop == size or len(gaps) > 2 * MOST_WORDS:
                break
            stop = min(size, stop + (stop - start))  # words longer than a window, or blanks only
        lead = int(not len(body) or body[0] != _BLANK)
        tail = int(stop == size and (not len(body) or body[-1] != _BLANK))
        line = b" " * lead + body.tobytes() + b" " * tail
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == _BLANK)
        # words that begin behind the last of these gaps belong to the next window
        whole = len(gaps) - 1 if stop == size else len(gaps) - 1 - MOST_WORDS
        for end, (long, kinds) in automaton.iter(line.decode("latin-1")):
            word = int(np.searchsorted(gaps, end - long + 1))
            if word < whole:
                last = end - 1 - lead  # of the phrase's last byte
                found.places(done + word, start + int(where[last]) + 1, kinds, text)
        done += whole
        if stop == size:
            break
        start += int(where[gaps[whole] - lead])
    found.n_words = done
    return found


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
_KINDS = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scanned(batches):
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            f = scan_text(text or b"")
            rows.append((f.n_words, f.n_base, f.first_word, f.last_word, sorted(f.base_labels), sorted(f.labels), f.score))
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), _KINDS)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *_NAMES])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, n_words, n_base (places of base phrases), first_word and
    last_word (of those places), base_labels, labels, score."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scanned), f"id {kind}, {SCANNED}").withColumnRenamed("id", id_col)
