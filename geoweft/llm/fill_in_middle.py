"""Fill-in-the-middle over seekable compressed frames.

A text is a row of units: longest runs of A to Z letters, and single other characters. It is
stored as frames, independent zstandard frames of at most `FRAME_BYTES` bytes cut at characters,
each with the numbers of units and characters before it. Two units drawn from a hash of the id
cut a text into prefix, middle and suffix; only the frames that hold a cut are decompressed to
find its place. What is written are frames again, in the order of the output; digests stream
over frames in their order, and never hold more than one of a long text.

Texts of one frame (nearly all) are decided and written where they are. Frames of longer ones
are a stored table; to be read in order they are shuffled by text.

Outputs: plain, the text; psm, `<P>`prefix`<S>`suffix`<M>`middle; spm, `<S>`suffix`<P>`prefix
`<M>`middle. Texts that are empty or hold a mark, and the share that isn't drawn, stay plain.

Defined cases: a null text counts as empty, a null id as an empty number; repeated rows (and
ids) are rows of their own; texts of any length are read in windows; an empty table gives no
rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored
from .arrow import slices

FRAME_BYTES = 1 << 16
LEVEL = 3
# Bytes of frames sent at a time.
SENT_BYTES = 1 << 22

# ---- fixed values: marks and shares of the specification ----
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
# -------------------------------------------------------------
# Sections of an output in their order, and of a text in the order of the text.
WRITTEN = {"plain": ("text",), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
READ = {"plain": ("text",), "psm": ("prefix", "middle", "suffix"), "spm": ("prefix", "middle", "suffix")}
MARKS = {"text": b"", "prefix": PREFIX, "suffix": SUFFIX, "middle": MIDDLE}


# ---- units ---------------------------------------------------------------------

def _starts(raw: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of UTF-8 bytes: which begin a unit, which begin a character, and whether the last one is
    a letter. `joined`: the byte before was a letter."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    character = (raw & 0xC0) != 0x80
    begins = character & ~(letter & np.concatenate([[joined], letter[:-1]]))
    return begins, character, bool(letter[-1]) if len(raw) else joined


def drawn(name: str, units: int) -> tuple[str, int, int]:
    """Form of a text that may be cut, and the units before its first and second cut."""
    digest = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    cuts = sorted((h1 % (units + 1), h2 % (units + 1)))
    form = "plain" if h3 % 100 >= FIM_PERCENT else "spm" if h4 % 100 < SPM_PERCENT else "psm"
    return form, *cuts


def place(frame: bytes, joined: bool, units: int) -> tuple[int, int]:
    """Bytes and characters of a frame before the unit of this number that begins in it; those
    of the whole frame if none does."""
    begins, character, _ = _starts(np.frombuffer(frame, np.uint8), joined)
    at = np.flatnonzero(begins)
    end = int(at[units]) if units < len(at) else len(frame)
    return end, int(character[:end].sum())


# ---- frames ----------------------------------------------------------------------

FRAMES = (
    "row long, no int, frames int, name string, units long, form string, cut1 long, cut2 long, "
    "first_unit long, first_char long, frame_units long, frame_chars long, joined boolean, payload binary")
_OF_TYPE = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _columns(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _OF_TYPE[kind]) for name, kind in (f.split() for f in ddl.split(", "))]


def _made(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    columns = _columns(ddl)
    values = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, columns)], [n for n, _ in columns])


def _cut(text, size: int):
    """Ends of frames, at most `size` bytes apart unless a character is longer."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and end > at + 1 and text[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield at, end
        at = end


def _framed(batches, size):
    """Texts as rows of frames; an empty text is one empty frame."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows: list[tuple] = []
    held = 0
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary())
        for row, name, value in zip(batch.column("row").to_pylist(), batch.column("name").to_pylist(), texts):
            text = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
            index, units, chars, joined, marked, tail = [], 0, 0, False, False, b""
            for start, end in _cut(text, size):
                begins, character, last = _starts(np.frombuffer(text[start:end], np.uint8), joined)
                own = int(begins.sum()), int(character.sum())
                index.append((start, end, units, chars, *own, joined))
                units, chars, joined = units + own[0], chars + own[1], last
                piece = tail + bytes(text[start:end])
                marked = marked or any(m in piece for m in (PREFIX, SUFFIX, MIDDLE))
                tail = piece[-2:]
            form, cut1, cut2 = ("plain", 0, 0) if marked or not units else drawn(name or "", units)
            index = index or [(0, 0, 0, 0, 0, 0, False)]
            for no, (start, end, first_unit, first_char, n_units, n_chars, behind) in enumerate(index):
                payload = packer.compress(text[start:end])
                rows.append((row, no, len(index), name, units, form, cut1, cut2, first_unit, first_char, n_units, n_chars, behind, payload))
                held += len(payload) + 100
                if held > SENT_BYTES:
                    yield _made(rows, FRAMES)
                    rows, held = [], 0
    yield _made(rows, FRAMES)


def frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored frame table: a text's frames by `row` and `no`, its id as text in `name`."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].cast("string").alias("name"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(partial(_framed, size=FRAME_BYTES), FRAMES))


# ---- selection -------------------------------------------------------------------

PLACES = "row long, cut int, no int, at int, chars long"


def _places(batches):
    """(row, cut, no, at, chars): of frames that hold cuts, where the cuts are."""
    reader = zstandard.ZstdDecompressor()
    for batch in slices(batches, "payload"):
        out = []
        for f in batch.to_pylist():
            frame = reader.decompress(f["payload"])
            last = f["no"] == f["frames"] - 1
            for cut in (1, 2):
                inside = f[f"cut{cut}"] - f["first_unit"]
                if 0 <= inside < f["frame_units"] or (last and inside == f["frame_units"]):
                    at, chars = place(frame, f["joined"], inside)
                    out.append((f["row"], cut, f["no"], at, f["first_char"] + chars))
        yield _made(out, PLACES)


def places(long: DataFrame) -> DataFrame:
    """(row, no1, at1, chars1, no2, at2, chars2) of the texts of several frames that are cut;
    only the frames that hold a cut are decompressed."""
    holds = " OR ".join(
        f"(cut{c} >= first_unit AND (cut{c} < first_unit + frame_units OR (no = frames - 1 AND cut{c} = first_unit + frame_units)))" for c in (1, 2))
    found = long.filter("form != 'plain'").filter(holds).mapInArrow(_places, PLACES)
    def of(c):
        return [F.max(F.when(F.col("cut") == c, F.col(k))).alias(f"{k}{c}") for k in ("no", "at", "chars")]

    return found.groupBy("row").agg(*of(1), *of(2))


# ---- output ------------------------------------------------------------------------

OUTPUT = "row long, name string, units long, form string, prefix_chars long, middle_chars long, section int, no int, opens boolean, payload binary"


def sections(form: str, no: int, frame: bytes, first: tuple[int, int], second: tuple[int, int]):
    """(section, opens, bytes) of the output that a text's frame holds; what opens a section
    begins with its mark. `first`, `second`: frame and place of the cuts."""
    if form == "plain":
        yield 0, no == 0, frame
        return
    begin, end = (len(frame) if no < c[0] else 0 if no > c[0] else c[1] for c in (first, second))
    # where each part begins: the prefix with the text, the others in the frame of their cut
    parts = {"prefix": (0, begin, no == 0), "middle": (begin, end, no == first[0]), "suffix": (end, len(frame), no == second[0])}
    for section, name in enumerate(WRITTEN[form]):
        start, stop, opens = parts[name]
        if opens or stop > start:
            yield section, opens, (MARKS[name] if opens else b"") + frame[start:stop]


def _written(batches):
    """Output frames of text frames with their cuts."""
    packer, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for batch in slices(batches, "payload"):
        rows = []
        for f in batch.to_pylist():
            frame = reader.decompress(f["payload"])
            first, second = (f["no1"], f["at1"]), (f["no2"], f["at2"])
            cut = f["form"] != "plain"
            chars = (f["chars1"], f["chars2"] - f["chars1"]) if cut else (None, None)
            for section, opens, piece in sections(f["form"], f["no"], frame, first, second):
                rows.append((f["row"], f["name"], f["units"], f["form"], *chars, section, f["no"], opens, packer.compress(piece)))
        yield _made(rows, OUTPUT)


def long_outputs(table: DataFrame) -> DataFrame:
    """Stored output frames (row, section, no) of the texts of several frames."""
    long = table.filter("frames > 1")
    cuts = stored(places(long))
    return stored(long.join(cuts, "row", "left").select(
        "row", "no", "frames", "name", "units", "form", "payload", *[f"{k}{c}" for c in (1, 2) for k in ("no", "at", "chars")],
    ).mapInArrow(_written, OUTPUT))


def one_frame(frame: dict, text: bytes) -> tuple[bytes, int | None, int | None]:
    """Output of a text of one frame, and the characters of its prefix and middle."""
    if frame["form"] == "plain":
        return text, None, None
    (at1, chars1), (at2, chars2) = (place(text, False, frame[c]) for c in ("cut1", "cut2"))
    return b"".join(p for _, _, p in sections(frame["form"], 0, text, (0, at1), (0, at2))), chars1, chars2 - chars1


def restored(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    parts, rest = {}, output[len(MARKS[WRITTEN[form][0]]):]
    for name, following in zip(WRITTEN[form], [*WRITTEN[form][1:], None]):
        parts[name], _, rest = rest.partition(MARKS[following]) if following else (rest, b"", b"")
    return b"".join(parts[name] for name in READ[form])


# ---- digests ------------------------------------------------------------------------

FOUND = "row long, name string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _short(batches):
    reader = zstandard.ZstdDecompressor()
    for batch in slices(batches, "payload"):
        rows = []
        for f in batch.to_pylist():
            output, prefix, middle = one_frame(f, reader.decompress(f["payload"]))
            back = restored(output, f["form"])
            rows.append((f["row"], f["name"], f["units"], f["form"], prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest()))
        yield _made(rows, FOUND)


STREAM = "row long, stream int, name string, n long, form string, prefix_chars long, middle_chars long, sha256 string"


def _digests(batches):
    """The digest of each stream, of frames that come in the order of their streams: stream 0 is
    the output, stream 1 the text it is read back to, where marks are left out."""
    reader = zstandard.ZstdDecompressor()
    open_, digest = None, hashlib.sha256()
    done: list[tuple] = []
    names = ["row", "stream", "name", "units", "form", "prefix_chars", "middle_chars", "section", "opens", "payload"]
    for batch in slices(batches, "payload"):
        for *facts, section, opens, payload in zip(*(batch.column(c).to_pylist() for c in names)):
            if open_ is None or open_[:2] != facts[:2]:
                if open_ is not None:
                    done.append((*open_, digest.hexdigest()))
                open_, digest = facts, hashlib.sha256()
            piece = reader.decompress(payload)
            if facts[1] and opens:
                mark = MARKS[WRITTEN[facts[4]][section]]
                if not piece.startswith(mark):
                    raise ValueError("an output's section doesn't begin with its mark")
                piece = piece[len(mark):]
            digest.update(piece)
        yield _made(done, STREAM)
        done.clear()
    if open_ is not None:
        yield _made([(*open_, digest.hexdigest())], STREAM)


def _place_in_text() -> Column:
    """Place of an output's section in the text that it is read back to."""
    return F.coalesce(*[F.when((F.col("form") == form) & (F.col("section") == s), F.lit(READ[form].index(name)))
                        for form, names in WRITTEN.items() for s, name in enumerate(names)])


def long_digests(out: DataFrame) -> DataFrame:
    """Digests of the outputs of several frames, and of the texts that they are read back to."""
    streams = out.withColumn("stream", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "place", F.when(F.col("stream") == 0, F.col("section")).otherwise(_place_in_text()))
    ordered = streams.repartition("row", "stream").sortWithinPartitions("row", "stream", "place", "no")
    digests = ordered.mapInArrow(_digests, STREAM)
    facts = [F.first(n).alias(n) for n in FACTS]
    return digests.groupBy("row").agg(*facts, *[
        F.max(F.when(F.col("stream") == k, F.col("sha256"))).alias(n) for k, n in enumerate(("output_sha256", "restored_sha256"))])


FACTS = ["name", "n", "form", "prefix_chars", "middle_chars"]


def _short_written(batches):
    packer, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for batch in slices(batches, "payload"):
        rows = []
        for f in batch.to_pylist():
            output, prefix, middle = one_frame(f, reader.decompress(f["payload"]))
            rows.append((f["row"], f["name"], f["units"], f["form"], prefix, middle, 0, 0, True, packer.compress(output)))
        yield _made(rows, OUTPUT)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The transformed texts as compressed frames: row (number of the document's row), id, form,
    section, no, payload. A text's output is its frames in the order of section and no."""
    table = frames(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    every = table.filter("frames = 1").mapInArrow(_short_written, OUTPUT).unionByName(long_outputs(table))
    return every.select("row", F.expr(f"CAST(name AS {kind})").alias(id_col), "form", "section", "no", "payload")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, n (units), form, prefix_chars and middle_chars (null if
    plain), output_sha256, restored_sha256."""
    table = frames(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    found = table.filter("frames = 1").mapInArrow(_short, FOUND).unionByName(long_digests(long_outputs(table)))
    return found.select(F.expr(f"CAST(name AS {kind})").alias(id_col), *FACTS[1:], "output_sha256", "restored_sha256")
