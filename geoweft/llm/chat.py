"""Chat formatting in windows of a token budget.

The turns of a conversation lie on a line, each as long as its tokens; prefix sums give their
places. The line is cut into cells, and a window takes the turns that begin in one cell, so it
holds whole turns and about as many tokens as the budget leaves for new ones. A turn longer
than a cell is a window of its own. Every window also repeats the system turn the conversation
opens with (of a longer one its first `SYSTEM` tokens; all of it is in the first window), and the
turns just before it as far as the history's budget and what is left of the whole allow. So no
window exceeds the budget but one of a single new turn that leaves no room for the system turn.
The loss mask covers the texts of the assistant's new turns only, so each of them is learned once.

Template: `### role: text</turn>` and a line break for every turn. In roles and texts a
backslash stands before every backslash, `### ` and `</turn>` (and `:` in roles), so that what
was written can be read back exactly.

Prefix sums are taken over range partitions of (conversation, turn), then over the partitions
of a conversation, so a conversation that holds a large share of all rows is spread.

Defined cases: null texts and roles count as empty; null conversation ids are one conversation;
null turns come first; turns of the same number are ordered by role and text, and a repeated
row is a turn of its own; a conversation of any length, a turn longer than the budget and
an empty table are all right; further columns of the input are ignored.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grid import stored

# Tokens (words and single marks) of a window, and of them those for repeated history and for the
# repeated system turn.
BUDGET, HISTORY, SYSTEM = 512, 128, 128
# The least that may be left for new turns.
LEAST_NEW = 2
TOKEN = r"\w+|[^\w\s]"
ROWS_PER_PART = 500_000

# The template's control strings.
OPEN, CLOSE = "### ", "</turn>"

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace(CLOSE, "\\" + CLOSE).replace(OPEN, "\\" + OPEN)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


def _assembled(batches):
    """Formatted text of each window, the spans under its loss mask, and how many turns it repeats."""
    for batch in batches:
        formatted, spans, repeated = [], [], []
        for pieces in batch.column("pieces").to_pylist():
            out, at, under = [], 0, []
            for p in pieces:
                head = f"{OPEN}{escaped(p['role']).replace(':', chr(92) + ':')}: "
                body = escaped(p["text"])
                if p["kind"] == 2 and p["role"] == "assistant":
                    under.append({"start": at + len(head), "end": at + len(head) + len(body)})
                out.append(f"{head}{body}{CLOSE}\n")
                at += len(out[-1])
            formatted.append("".join(out))
            spans.append(under)
            repeated.append(sum(p["kind"] < 2 for p in pieces))
        kept = [batch.column(c) for c in ("conv_id", "window", "tokens")]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(formatted, pa.string()), pa.array(spans, kind), pa.array(repeated, pa.int32())],
            ["conv_id", "window", "tokens", "text", "loss", "repeated"])


def _on_a_line(turns: DataFrame) -> DataFrame:
    """Each turn with its number in the conversation and the tokens before it."""
    order = ["conv", "turn", "role", "text"]
    light = turns.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + 1).cast("long"))
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), light.count() // ROWS_PER_PART)
    ranged = stored(light.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("conv", "part").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition at most
    offsets = totals.select(
        "conv", "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
    )
    here = Window.partitionBy("conv", "part").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("tokens").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("before", before).withColumn("no", F.row_number().over(here) - 1).join(offsets, ["conv", "part"]).select(
        "conv", "conv_id", "role", "text", "tokens", (F.col("before") + F.col("t0")).alias("start"), (F.col("no") + F.col("n0")).alias("seq"),
    )


def windows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """A row per window: its conversation's id, window (the number of its first new turn), tokens,
    text, loss (spans of the text under the mask) and repeated (turns at its beginning that
    earlier windows hold; of a long system turn only the beginning is repeated)."""
    if budget < history + system + LEAST_NEW:
        raise ValueError(f"a budget of {budget} tokens leaves nothing for new turns beside {history} of history and {system} of a system turn")
    own = conversations[id_col]
    turns = conversations.select(
        F.when(own.isNull(), "null").otherwise(F.concat(F.lit("#"), own.cast("string"))).alias("conv"), own.alias("conv_id"),
        conversations[turn_col].alias("turn"), F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    )
    line = stored(_on_a_line(turns))
    opens = F.expr("seq = 0 AND role = 'system'")
    openings = line.filter(opens).select("conv", F.least("tokens", F.lit(system)).alias("kept"))
    # cells leave room for the history and the system turn; two fit what is left of the budget
    placed = stored(
        line.join(openings, "conv", "left").fillna(0, "kept").withColumn("cell", F.expr(f"({budget - history}L - kept) DIV 2"))
        .withColumn("at", F.expr("start DIV cell")).withColumn("big", F.expr("tokens > cell"))
    )
    key = ["conv", "at", "big"]
    room = F.expr(f"greatest(0L, least({history}L, {budget}L - first(kept) - sum(tokens)))")  # for history
    starts = stored(placed.groupBy(*key).agg(F.min("start").alias("window_start"), room.alias("room")))
    piece = [F.col(c) for c in (*key, "conv_id")]

    def pieces(df, kind):
        return df.select(*piece, F.struct(F.lit(kind).alias("kind"), "seq", "role", "text", "tokens").alias("piece"))

    reach = F.expr(f"sequence((start + tokens) DIV cell, (start + {history}) DIV cell)")
    fits = placed.filter(~opens & (F.col("tokens") <= history))
    past = fits.drop("at", "big").withColumn("at", F.explode(reach)).join(starts, ["conv", "at"]).filter(
        "window_start >= start + tokens AND window_start <= start + room",
    )
    first_tokens = F.regexp_extract("text", rf"^\s*+(?:(?:\w++|[^\w\s])\s*+){{0,{system - 1}}}", 0)
    shortened = placed.filter(opens).withColumn("text", F.when(F.col("tokens") > system, first_tokens).otherwise(F.col("text")))
    again = shortened.drop("at", "big").join(starts, "conv").filter("window_start >= start + tokens").withColumn("tokens", F.col("kept"))
    every = pieces(placed, 2).unionByName(pieces(past, 1)).unionByName(pieces(again, 0))
    # a window is bounded by its budget, or is a single turn
    made = every.groupBy(*key).agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    ready = made.select(
        "conv_id", F.expr("filter(pieces, p -> p.kind = 2)[0].seq").alias("window"),
        F.expr("aggregate(pieces, 0L, (s, p) -> s + p.tokens)").alias("tokens"), "pieces",
    )
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, window long, tokens long, text string, loss array<struct<start: int, end: int>>, repeated int"
    return ready.mapInArrow(_assembled, schema).withColumnRenamed("conv_id", id_col)


def _read(batches):
    for batch in batches:
        turns, counts, losses = [], [], []
        for text, loss, repeated in zip(*(batch.column(c).to_pylist() for c in ("text", "loss", "repeated"))):
            new = parsed(text)[repeated:]
            turns.append("".join(f"{role}\n{body}\n" for role, body in new))
            counts.append(len(new))
            losses.append("".join(unescaped(text[s["start"]:s["end"]]) for s in loss))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("window"), pa.array(turns, pa.string()), pa.array(counts, pa.int64()), pa.array(losses, pa.string()),
             pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())],
            ["conv_id", "window", "turns", "n_turns", "loss", "chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window of `windows`: its new turns (role, line break, text, line break each), their
    number, the text under the loss mask, and the length of the formatted text."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "window", "text", "loss", "repeated").mapInArrow(
        _read, f"conv_id {kind}, window long, turns string, n_turns long, loss string, chars long")
