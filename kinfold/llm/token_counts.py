"""Token counts by prefix dynamic programming.

The table of last tokens gives the exact count of *every* prefix of a piece, so
counts, truncation and budget questions are look-ups, without encoding:

* ``counted`` adds the counts of whole texts, whether they are over a limit and
  the longest prefix that is not;
* ``prefix_counts`` adds an array with the count of each prefix, by code point.

A prefix is split into pieces as the tokenizer would split the prefix *alone*.
That differs from the whole text's split in two places only, which have table
entries of their own: a white-space run that ends the prefix is one piece (in the
text its last character is not part of that piece), and a contraction of three
characters that is cut to two falls into two pieces of one token each.  So the
pieces must be those of the pattern that byte-level BPE files come with.

Defined results: a null text counts as empty (0 bytes, 0 tokens, 0 characters in
the limit); special strings inside a text are one token each, as the tokenizer's
default is, and where a prefix cuts one, its beginning is plain text; repeated
rows count each; other columns come along if ``keep`` names them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.names import fresh

from .bpe import vocabulary
from .prefix_bpe import CACHE_CHARS, CHUNK, PrefixBpe, TwoAges, ranks_of_json

#: Fixed value: the pattern that the rules of cut pieces hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT_IN_TWO = ("'re", "'ve", "'ll")
_WHITE = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))


class TokenCounter:
    """Tables of prefix counts over texts with special strings."""

    def __init__(self, content: bytes, pattern: str):
        if pattern != PATTERN:
            raise ValueError(f"how prefixes split is known for one pattern only, not for {pattern}")
        ranks, special = ranks_of_json(content)
        self.bpe = PrefixBpe(ranks, pattern)
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._tables, self._chunks = TwoAges(), TwoAges()

    # -- tables ----------------------------------------------------------------

    def table(self, piece: str) -> Sequence[int]:
        """Token count of every byte prefix of one piece, from 0 bytes on."""
        known = self._tables.get(piece)
        if known is None:
            counts = self.bpe.prefix_counts(piece.encode("utf-8", "surrogatepass"))
            if len(piece) > CACHE_CHARS:
                return array("I", counts)
            known = bytes(counts)
            self._tables.put(piece, known)
        return known

    def _chunk(self, chunk: str) -> int:
        return sum(self.table(piece)[-1] for piece in self.bpe.pieces(chunk))

    def _chunk_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Chunks of a text (all but the first less their leading space), which
        no piece crosses, and the last entry of each one's tables."""
        chunks, parts = self._chunks, CHUNK.split(text)
        counts = [self._chunk(parts[0])]
        for part in parts[1:]:
            n = chunks.new.get(part)
            if n is None:
                n = chunks.get(part)
                if n is None:
                    n = self._chunk(" " + part)
                    if len(part) <= CACHE_CHARS:
                        chunks.put(part, n)
            counts.append(n)
        return parts, counts

    def _segments(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end of the plain text, end of the special string behind it)."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield at, m.start(), m.end()
            at = m.end()
        yield at, len(text), len(text)

    # -- questions ---------------------------------------------------------------

    def count(self, text: str) -> int:
        return sum(sum(self._chunk_counts(text[at:start])[1]) + (end > start) for at, start, end in self._segments(text))

    def longest(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of the text, code points of its longest prefix with at most
        ``limit`` tokens); counts may fall as a prefix grows."""
        total, best = 0, 0
        for at, start, end in self._segments(text):
            parts, counts = self._chunk_counts(text[at:start])
            n = sum(counts) + (end > start)
            if total + n <= limit:
                best = end
            elif total <= limit:
                whole = (parts, counts) if end == start else self._chunk_counts(text[at : end - 1])
                best = max(best, at + self._longest_plain(text[at : max(start, end - 1)], *whole, limit - total))
            total += n
        return total, best

    def _longest_plain(self, text: str, parts: list[str], counts: list[int], limit: int) -> int:
        """The chunk that crosses the limit, and those beside it, tell."""
        upto, j, start = 0, 0, 0
        while j < len(parts) and upto + counts[j] <= limit:
            upto += counts[j]
            start += len(parts[j]) + (j > 0)
            j += 1
        if j == len(parts):
            return len(text)
        if j:
            upto -= counts[j - 1]
            start -= len(parts[j - 1]) + (j > 1)
        end = start + sum(len(parts[i]) + (i > 0) for i in range(max(0, j - 1), min(j + 2, len(parts))))
        inside = np.asarray(self._plain(text[start:end]))
        return start + int(np.flatnonzero(inside + upto <= limit)[-1])

    def prefixes(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i], for every code point i from 0 on."""
        counts, base = [0], 0
        for at, start, end in self._segments(text):
            inside = self._plain(text[at : max(start, end - 1)])  # a cut special string is plain text
            counts += [base + c for c in inside[1:]]
            base += inside[start - at]
            if end > start:
                base += 1
                counts.append(base)
        return np.asarray(counts, "i4")

    def _by_char(self, piece: str) -> list[int]:
        """The table of a piece at its code points, from the first on."""
        table = self.table(piece)
        if len(table) == len(piece) + 1:
            return list(table[1:])
        out, used = [], 0
        for ch in piece:
            used += len(ch.encode("utf-8", "surrogatepass"))
            out.append(table[used])
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts of the prefixes of a text without special strings."""
        counts, before, pieces = [0], 0, self.bpe.pieces(text)
        seen = False  # the first character of this piece has its entry already
        for k, piece in enumerate(pieces):
            if piece[-1] in _WHITE:
                if seen:  # the last character of a run, as a piece of its own
                    before, seen = before + self.table(piece)[-1], False
                    continue
                behind = pieces[k + 1][0] if k + 1 < len(pieces) else ""
                seen = behind in _WHITE and behind != ""
                run = self._by_char(piece + behind if seen else piece)
                counts += [before + c for c in run]
                before += run[len(piece) - 1]
                continue
            inside = self._by_char(piece)
            if piece in _CUT_IN_TWO:
                inside[1] = 2
            counts += [before + c for c in (inside[1:] if seen else inside)]
            before, seen = before + inside[-1], False
        return counts


@lru_cache(maxsize=2)
def counter(content: bytes, pattern: str) -> TokenCounter:
    return TokenCounter(content, pattern)


def counted(docs: DataFrame, path: str, pattern: str, limit: int, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` plus n_bytes (UTF-8), n_tokens, over_limit (more tokens than
    ``limit``) and limit_chars (code points of the longest prefix that is not)
    of each row's whole text."""
    shared = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, limit_chars long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(shared.value, pattern)
        for texts in batches:
            yield pd.DataFrame([own.longest(t or "", limit) for t in texts], columns=["n_tokens", "limit_chars"], dtype="int64")

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    (made,) = fresh(docs.columns, "made")
    rows = docs.select(*keep, n_bytes.alias("n_bytes"), tokens(F.col(text)).alias(made))
    kept = [c for c in rows.columns if c not in (made, "n_tokens", "limit_chars", "over_limit")]
    n = F.col(f"{made}.n_tokens")
    return rows.select(*kept, n.alias("n_tokens"), (n > F.lit(limit)).alias("over_limit"), F.col(f"{made}.limit_chars").alias("limit_chars"))


def prefix_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "prefix_tokens") -> DataFrame:
    """``docs`` with ``into``: array<int> of the token count of every prefix of
    the text, at index i that of its first i code points (index 0: none)."""
    shared = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(shared.value, pattern)
        for texts in batches:
            yield pd.Series([own.prefixes(t or "") for t in texts], dtype=object)

    return docs.withColumn(into, table(F.col(text)))


def longest_prefix(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens, from
    the array of ``prefix_counts``; counts may fall as a prefix grows."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
