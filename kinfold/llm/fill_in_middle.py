"""Fill-in-middle training examples from piece tables.

A document is never cut into new strings.  It becomes a *piece table*: a list of
descriptors (buffer, start, end) over immutable buffers, the UTF-8 text and the
three sentinels.  Cutting splits descriptors at line borders, an arrangement is a
permutation of them, and restoring applies the inverse permutation to a table
over the output alone.  Digests walk the descriptors, so neither the output nor
the restored text needs to exist to be hashed or counted.

Every row is decided by itself: nothing is shuffled, and a task holds one batch.
The cuts and forms come from the first four 8-digit groups of the sha256 of
``seed:id``, so reruns and other partitionings agree.

Defined results: a null or empty text, and one that holds a sentinel already, is
plain (the output is the text, no part has a length); a null id counts as an
empty one; repeated rows get the same cuts; parts may be empty; extra columns of
any name stay, except those that the operator names, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.names import fresh

#: The strings before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Places of prefix, middle, suffix and the three sentinels in an output.
PREFIX, MIDDLE, SUFFIX, SAYS_PREFIX, SAYS_SUFFIX, SAYS_MIDDLE = range(6)
ORDERS = {
    "psm": (SAYS_PREFIX, PREFIX, SAYS_SUFFIX, SUFFIX, SAYS_MIDDLE, MIDDLE),
    "spm": (SAYS_SUFFIX, SUFFIX, SAYS_PREFIX, PREFIX, SAYS_MIDDLE, MIDDLE),
}
TEXT = 0  # the buffer of the text; the sentinels follow


def inverse(order: Sequence[int]) -> list[int]:
    """Where each descriptor of an arrangement stood before it."""
    return sorted(range(len(order)), key=order.__getitem__)


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, end) over buffers that never change."""

    buffers: tuple[bytes, ...]
    spans: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: bytes, *others: bytes) -> PieceTable:
        """The whole of each buffer, one descriptor each."""
        buffers = (text, *others)
        return cls(buffers, tuple((i, 0, len(b)) for i, b in enumerate(buffers)))

    def cut(self, which: int, offsets: Iterable[int]) -> PieceTable:
        """Descriptor ``which`` split at offsets from its start, in order."""
        buffer, start, end = self.spans[which]
        borders = [start, *(start + o for o in offsets), end]
        made = tuple((buffer, a, b) for a, b in zip(borders, borders[1:], strict=False))
        return PieceTable(self.buffers, self.spans[:which] + made + self.spans[which + 1 :])

    def arrange(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.spans[i] for i in order))

    def first(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.spans[:n])

    def parts(self) -> Iterable[memoryview]:
        for buffer, start, end in self.spans:
            yield memoryview(self.buffers[buffer])[start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def to_bytes(self) -> bytes:
        return b"".join(self.parts())


def line_ends(text: bytes) -> np.ndarray:
    """Byte offsets behind every line; the last one may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def code_points(part: memoryview) -> int:
    """Bytes that don't continue a character."""
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Layout:
    """How documents are cut and arranged."""

    percent: int = 100
    spm_percent: int = 50
    sentinels: tuple[str, str, str] = SENTINELS

    def marks(self) -> tuple[bytes, ...]:
        return tuple(s.encode() for s in self.sentinels)

    def build(self, text: bytes, h: Sequence[int]) -> tuple[int, str, PieceTable]:
        """(lines, form, table of the output) for the four numbers of a document."""
        ends, marks = line_ends(text), self.marks()
        n = len(ends)
        if not n or any(m in text for m in marks) or h[2] % 100 >= self.percent:
            return n, "plain", PieceTable.of(text)
        cuts = [0 if k == 0 else int(ends[k - 1]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
        form = "spm" if h[3] % 100 < self.spm_percent else "psm"
        return n, form, PieceTable.of(text, *marks).cut(TEXT, cuts).arrange(ORDERS[form])

    def rebuild(self, output: bytes, form: str) -> PieceTable:
        """The text again, as a table over the output alone.  No part holds a
        sentinel, and none begins inside another, so each is found in its place."""
        table = PieceTable.of(output)
        if form not in ORDERS:
            return table
        marks, borders, at = self.marks(), [], 0
        for place in ORDERS[form][::2]:
            mark = marks[place - SAYS_PREFIX]
            at = output.index(mark, at)
            borders += [at, at + len(mark)]
            at += len(mark)
        return table.cut(0, borders[1:]).arrange(inverse(ORDERS[form])).first(3)


def numbers(id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _built(layout: Layout, texts: pd.Series, *h: pd.Series):
    for text, *own in zip(texts, *h, strict=True):
        text = b"" if text is None else bytes(text)
        yield text, layout.build(text, own)


def _lengths(form: str, table: PieceTable) -> tuple[int | None, int | None]:
    """Code points of prefix and middle."""
    if form == "plain":
        return None, None
    parts = list(table.arrange(inverse(ORDERS[form])).parts())
    return code_points(parts[PREFIX]), code_points(parts[MIDDLE])


_FACTS = ["n", "form", "prefix_chars", "middle_chars"]
_FACT_TYPES = "n long, form string, prefix_chars long, middle_chars long"
_SPANS = "array<struct<buffer: int, start: long, end: long>>"


def _with(docs: DataFrame, made: Column, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    (own,) = fresh(docs.columns, "fim")
    kept = [F.col(f"`{c}`") for c in keep if c.lower() not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(own))
    return rows.select(*kept, *[F.col(f"{own}.{n}").alias(n) for n in names])


def transform(docs: DataFrame, seed: int = 7, layout: Layout = Layout(), id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n (lines), form, prefix_chars and
    middle_chars (code points), ``spans`` (the descriptors of the output: buffer 0
    is the text in UTF-8, 1 to 3 are the sentinels) and ``output``."""

    @F.pandas_udf(f"{_FACT_TYPES}, spans {_SPANS}, output binary")
    def made(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = []
        for _, (n, form, table) in _built(layout, texts, a, b, c, d):
            spans = [dict(zip(("buffer", "start", "end"), s, strict=True)) for s in table.spans]
            rows.append((n, form, *_lengths(form, table), spans, table.to_bytes()))
        return pd.DataFrame(rows, columns=[*_FACTS, "spans", "output"], dtype=object)

    out = _with(docs, made(F.col(text).cast("binary"), *numbers(id, seed)), [*_FACTS, "spans", "output"], keep or docs.columns)
    return out.withColumn("output", F.col("output").cast("string"))


def restore(examples: DataFrame, layout: Layout = Layout(), output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``examples`` with the text that each output was made from."""

    @F.pandas_udf("binary")
    def made(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        both = zip(outputs, forms, strict=True)
        return pd.Series([None if o is None else layout.rebuild(bytes(o), f).to_bytes() for o, f in both], dtype=object)

    return examples.withColumn(into, made(F.col(output).cast("binary"), F.col(form)).cast("string"))


def digested(docs: DataFrame, seed: int = 7, layout: Layout = Layout(), id: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """What ``transform`` and ``restore`` give, as digests: ``keep`` plus n, form,
    prefix_chars, middle_chars, output_sha256 and restored_sha256, without sending
    the texts back from the workers."""

    @F.pandas_udf(f"{_FACT_TYPES}, output_sha256 string, restored_sha256 string")
    def made(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = []
        for _, (n, form, table) in _built(layout, texts, a, b, c, d):
            back = layout.rebuild(table.to_bytes(), form)
            rows.append((n, form, *_lengths(form, table), table.sha256(), back.sha256()))
        return pd.DataFrame(rows, columns=[*_FACTS, "output_sha256", "restored_sha256"], dtype=object)

    return _with(docs, made(F.col(text).cast("binary"), *numbers(id, seed)), [*_FACTS, "output_sha256", "restored_sha256"], keep)
