"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's expression a Boolean query of trigrams is derived: any match must hold all
trigrams of one of its branches. The postings (trigram, document) of all trigrams that some
query asks for are built in one pass, intersected per branch, and the candidates verified by
the expression itself. Rules without mandatory trigrams read every text.

Defined cases: a null text counts as empty and has no spans; documents that share an id share
their postings, which only adds candidates; an empty table gives no rows; further columns are
ignored.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored
from .bits import bitmap, flagged

# Alternatives kept apart while a query is derived; beyond them a part of the expression is
# taken to match anything, which weakens the query but never loses a match.
MOST_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern (valid in Python and Java), kept where
    `group` has at least `least` characters. `found_in`: a cheaper pattern that any text with
    a kept match matches."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    found_in: str | None = None


# The rules of the specification. For access keys and hex runs the shortest
# kept length is part of the pattern: a shorter run holds no kept match, and a longer one
# starts where the plain pattern's match starts.
RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}", found_in=r"[0-9a-f]{24}"),
)


def _alternatives(nodes) -> list[tuple]:
    """Sequences of characters and breaks (None) one of which any match follows."""
    out: list[tuple] = [()]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            some = [(chr(arg),)]
        elif name == "IN" and len(arg) <= 4 and all(str(o) == "LITERAL" for o, _ in arg):
            some = [(chr(c),) for _, c in arg]
        elif name == "BRANCH":
            some = [x for branch in arg[1] for x in _alternatives(branch)]
        elif name == "SUBPATTERN":
            some = _alternatives(arg[-1])
        elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
            some = [(), *_alternatives(arg[2])]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            some = [(*x, None) for x in _alternatives(arg[2])]
        elif name == "AT":
            continue
        else:
            some = [(None,)]
        joined = list(dict.fromkeys(a + b for a, b in product(out, some))) if len(out) * len(some) <= MOST_BRANCHES else []
        out = joined or [(*a, None) for a in out]
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """The branches of a rule's query, lower case; None if some match needs no trigram."""
    found = set()
    for way in _alternatives(re._parser.parse(rule.pattern)):
        runs = "".join("\0" if c is None else c for c in way).lower().split("\0")
        found.add(frozenset(run[i:i + 3] for run in runs for i in range(len(run) - 2)))
    if not all(found):
        return None
    return sorted((b for b in found if not any(other < b for other in found)), key=sorted)


def postings(docs: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for each of the trigrams that a lower-case text holds."""
    asked = F.array(*map(F.lit, trigrams))
    # the text is lowered once a row, not once a trigram
    held = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.filter(asked, lambda t: F.contains(low, t)))
    return docs.select(key.alias("key"), F.explode(F.element_at(held, 1)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(kind, key) of the documents in whose postings a branch of a rule is complete."""
    terms = [(kind, i, t, len(branch)) for kind, branches in queries.items() for i, branch in enumerate(branches) for t in sorted(branch)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, branch int, trigram string, needed int")  # a row per rule's trigram
    met = index.distinct().join(F.broadcast(asked), "trigram").groupBy("kind", "branch", "needed", "key").count()
    return met.filter("count = needed").select("kind", "key").distinct()


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Kept matches as structs (start, order, end, kind); places count code points."""
    # \G ties every match to the end of the one before, so the gaps add up to places
    body = f"(?i:{rule.pattern})" if rule.any_case else rule.pattern
    tied = F.lit(f"(?s)\\G(.*?)({body})")
    gaps, found = (F.regexp_extract_all(text, tied, F.lit(i)) for i in (1, 2))
    part = F.regexp_extract_all(text, tied, F.lit(2 + rule.group))
    sizes = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"))),
                       part, lambda s, p: F.struct(s.gap.alias("gap"), s.long.alias("long"), F.length(p).alias("part")))
    empty = "named_struct('at', 0, 'kept', CAST(array() AS ARRAY<STRUCT<start: INT, order: INT, end: INT, kind: STRING>>))"

    def step(state, x):
        span = F.struct(
            (state.at + x.gap).alias("start"), F.lit(order).alias("order"), (state.at + x.gap + x.long).alias("end"), F.lit(rule.kind).alias("kind"),
        )
        return F.struct(
            (state.at + x.gap + x.long).alias("at"),
            F.when(x.part >= rule.least, F.concat(state.kept, F.array(span))).otherwise(state.kept).alias("kept"),
        )

    return F.aggregate(sizes, F.expr(empty), step, lambda s: s.kept)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and `spans`, an array of (start, order, end, kind) sorted by
    start and the rules' order."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    key = F.xxhash64("id")
    queries = {r.kind: q for r in rules if (q := trigram_query(r)) is not None}
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, order: INT, end: INT, kind: STRING>>)")
    marked = rows
    if queries:
        trigrams = sorted({t for branches in queries.values() for b in branches for t in b})
        index = stored(postings(rows, key, F.col("text"), trigrams))
        bits = stored(bitmap(candidates(index, queries), F.xxhash64("kind", "key")))
        for kind in queries:
            marked = flagged(marked, F.xxhash64(F.lit(kind), key), bits, f"may_{kind}")
    kinds = []
    for order, rule in enumerate(rules):
        worth = F.col(f"may_{rule.kind}") if rule.kind in queries else F.lit(True)
        if rule.found_in:
            worth = worth & F.rlike(F.col("text"), F.lit(rule.found_in))
        kinds.append(F.when(worth, _spans(F.col("text"), rule, order)).otherwise(none))
    return marked.select(F.col("id").alias(id_col), F.array_sort(reduce(lambda a, b: F.concat(a, b), kinds)).alias("spans"))
