"""Fill-in-middle over seekable compressed frames.

Bavarian et al., "Efficient Training of Language Models to Fill in the Middle", 2022; the frame layout follows the idea of the
seekable Zstandard format: a text is cut into pieces of a bounded size, each compressed on its own, with the cumulative counts of
what stands before. `pack` stores a table of texts this way. To cut a text at a unit, only the frame that holds the unit is
decompressed; to write or digest a transformed text, its ranges are streamed frame by frame, so a task holds one frame of a
text at a time however long the text is.

A unit is a run of ASCII letters or one other character. It belongs to the frame in which it starts: a run may go on over any
number of frames, which then count no unit for it.

Cases: a null text is an empty one; an empty text, and one that holds a mark, stays plain; a null id draws as the empty text does;
rows that are equal get equal results; other columns, whatever their names, are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import id_and_bytes, map_rows, stored, table

#: Bytes of text in a frame at most, and the compression level.
FRAME_BYTES, LEVEL = 64 << 10, 3
#: What begins the prefix, the suffix and the middle.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: The order of the parts in each form.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Per cent of the texts that are transformed, and of those the per cent whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20

FRAME = T.StructType(
    [
        T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("inside", T.BooleanType()), T.StructField("data", T.BinaryType()),
    ]
)


def _starts(piece: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where characters start in a piece; inside: a run of letters goes on from the piece before."""
    raw = np.frombuffer(piece, np.uint8)
    letter = ((raw | 32) - np.uint8(97)) < 26
    begins = (raw & 0xC0) != 0x80
    run = np.empty(len(raw), bool)
    run[:1], run[1:] = inside, letter[:-1]
    return np.flatnonzero(begins & ~(letter & run)), begins


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of at most `size` bytes (at least 4) that end with a character."""
    at, size = 0, max(4, size)
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and end > at + size - 4 and text[end] & 0xC0 == 0x80:
            end -= 1
        yield text[at:end]
        at = end


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """(doc_id, units, chars, bytes, marked, frames) of every row; the counts in a frame are of what stands before it.

    marked: the text holds one of the marks. A frame is independent of all others.
    """
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()),
            T.StructField("bytes", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("frames", T.ArrayType(FRAME)),
        ]
    )

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level)
        for i, text in texts:
            frames, units, chars, size, inside = [], 0, 0, 0, False
            for piece in _pieces(text, frame_bytes):
                starts, begins = _starts(piece, inside)
                frames.append({"units": units, "chars": chars, "bytes": size, "inside": inside, "data": press.compress(piece)})
                units, chars, size = units + len(starts), chars + int(begins.sum()), size + len(piece)
                inside = piece[-1:].isalpha()
            yield i, units, chars, size, any(m in text for m in MARKS.values()), frames

    return map_rows(id_and_bytes(docs, id_col, text_col), out, rows, size=64)


class Reader:
    """Random access to a packed text; the frame read last is kept."""

    def __init__(self, units: int, chars: int, size: int, frames: list[dict]):
        import zstandard

        self.units, self.chars, self.size, self.frames = units, chars, size, frames
        self._before = [f["units"] for f in frames]
        self._bytes = [f["bytes"] for f in frames]
        self._press, self._held = zstandard.ZstdDecompressor(), (-1, b"")
        self.opened = 0

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = k, self._press.decompress(bytes(self.frames[k]["data"]))
            self.opened += 1
        return self._held[1]

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and characters before a unit; all of them for one beyond the last. Opens one frame."""
        if unit >= self.units:
            return self.size, self.chars
        k = bisect_right(self._before, unit) - 1  # of frames with equal counts only the last has a start
        starts, begins = _starts(self._frame(k), self.frames[k]["inside"])
        at = int(starts[unit - self._before[k]])
        return self._bytes[k] + at, self.frames[k]["chars"] + int(begins[:at].sum())

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes of a range, frame by frame; frames beside it stay shut."""
        k = max(0, bisect_right(self._bytes, begin) - 1)
        while begin < end:
            base, piece = self._bytes[k], self._frame(k)
            yield piece[begin - base : end - base]
            begin, k = base + len(piece), k + 1


def drawn(doc_id: object, seed: int = 1) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed:id; a null id is the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _output(reader: Reader, form: str, cuts: tuple[int, int]) -> Iterator[bytes]:
    """The transformed text in pieces."""
    if form == "plain":
        yield from reader.stream(0, reader.size)
        return
    ranges = {"prefix": (0, cuts[0]), "middle": cuts, "suffix": (cuts[1], reader.size)}
    for part in ORDERS[form]:
        yield MARKS[part]
        yield from reader.stream(*ranges[part])


def restored(output: Callable[[], Iterator[bytes]], form: str) -> Iterator[bytes]:
    """The original text, in pieces, from the pieces of a transformed one and its form; `output` is called once for each pass.

    No mark arises at a seam: each begins with a character that it holds once, and the texts hold no mark.
    """
    if form == "plain":
        yield from output()
        return
    begins, wanted, tail, at = [], list(ORDERS[form]), b"", 0  # a first pass finds the marks
    for piece in output():
        held = tail + piece
        start = 0
        while wanted and (found := held.find(MARKS[wanted[0]], start)) >= 0:
            begins.append(at - len(tail) + found)
            start = found + 3
            wanted.pop(0)
        at += len(piece)
        tail = held[max(start, len(held) - 2) :]
    ends = [*begins[1:], at]
    ranges = {part: (b + 3, e) for part, b, e in zip(ORDERS[form], begins, ends, strict=True)}
    for part in ("prefix", "middle", "suffix"):
        begin, end = ranges[part]
        at = 0
        for piece in output():
            if at >= end:
                break
            yield piece[max(0, begin - at) : max(0, end - at)]
            at += len(piece)


def _digest(pieces: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for piece in pieces:
        out.update(piece)
    return out.hexdigest()


def fill_in_middle(packed: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1, outputs: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every packed text; with `outputs` also the text.

    n counts the units. Of the four numbers drawn from seed and id, two cut at units, the third leaves a text plain, the fourth
    puts the suffix first. output_sha256 is the digest of the transformed text, restored_sha256 that of the text rebuilt from it.
    """
    fields = [
        T.StructField("doc_id", packed.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
        T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()),
    ]
    if outputs:
        fields.append(T.StructField("output", T.StringType()))

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for i, units, chars, size, marked, frames in texts:
            reader = Reader(units, chars, size, frames)
            h = drawn(i, seed)
            first, last = sorted((h[0] % (units + 1), h[1] % (units + 1)))
            plain = units == 0 or marked or h[2] % 100 >= rate
            form = "plain" if plain else "spm" if h[3] % 100 < suffix_first else "psm"
            (a, before), (b, upto) = ((0, 0), (0, 0)) if plain else (reader.place(first), reader.place(last))
            made = lambda reader=reader, form=form, cuts=(a, b): _output(reader, form, cuts)
            row = i, units, form, None if plain else before, None if plain else upto - before, _digest(made()), _digest(restored(made, form))
            yield (*row, b"".join(made()).decode("utf-8", "replace")) if outputs else row

    columns = ("doc_id", "units", "chars", "bytes", "marked", "frames")
    return map_rows(packed.select(*columns), T.StructType(fields), rows, size=64 if outputs else 4096)


def units_between(packed: DataFrame, begin: int, end: int) -> DataFrame:
    """(doc_id, text): the units from `begin` to before `end` of every packed text; only the frames that hold them are opened."""
    out = T.StructType([T.StructField("doc_id", packed.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def rows(texts: Iterator[tuple]) -> Iterable[tuple]:
        for i, units, chars, size, frames in texts:
            reader = Reader(units, chars, size, frames)
            a, b = reader.place(max(0, begin))[0], reader.place(max(0, end))[0]
            yield i, b"".join(reader.stream(a, b)).decode("utf-8", "replace")

    return map_rows(packed.select("doc_id", "units", "chars", "bytes", "frames"), out, rows, size=64)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the transformed text of every document."""
    packed, _ = stored(pack(table(spark, sf_dir, "documents")), "frames")
    return fill_in_middle(packed)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p
), b AS (
  SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM o
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN output[4:at_s - 1] || output[at_m + 3:] || output[at_s + 3:at_m - 1]
              ELSE output[at_p + 3:at_m - 1] || output[at_m + 3:] || output[4:at_p - 1] END) AS restored_sha256
FROM b
"""
