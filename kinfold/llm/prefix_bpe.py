"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one valid encoding, so it has exactly one
valid *last token*.  ``PrefixBpe.last_tokens`` fills that table from left to
right: token ``t`` ends prefix ``i`` if the last token of the prefix before
``t`` and ``t`` itself may stand side by side, i.e. merging both together gives
back the same two tokens.  The encoding is read off backwards, the token count
of a prefix is one more than that of the prefix before its last token, appends
only add columns to the table, and an edit only redoes the columns behind it.

Texts are mostly short pieces that begin alike, so ``ids_of`` keeps one table for
all of them, keyed by the prefix itself and filled from the right: only the
prefixes that an encoding reaches are looked at, and most are known already.

Helpers of the Spark operators in ``bpe`` and ``token_counts``: they work on
one text at a time and hold a bounded cache.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np
import regex

#: Entries kept in a worker's cache of encoded chunks.
CACHE_ENTRIES = 250_000
#: Entries kept in a worker's table of prefixes.
PREFIX_ENTRIES = 125_000
#: Pieces of more bytes have tables of their own.
PREFIX_BYTES = 96
#: Chunks longer than this are encoded without being cached.
CACHE_CHARS = 48

#: Borders that no piece crosses; the space belongs to what follows.
CHUNK = re.compile(r" (?=\S)")
#: Spaces that are no such border; without them a text is split at every space.
BLANKS = re.compile(r" (?:\s|\Z)")


class TwoAges:
    """A bounded cache: the newest entries and the ones before them."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.new, self.old = entries, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PrefixBpe:
    """``ranks``: token bytes -> rank (a smaller rank merges earlier)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._raw = np.empty(max(self.bytes_of, default=-1) + 1, object)
        self._raw[list(self.bytes_of)] = list(ranks)
        #: Longest token that ends in given four bytes.
        self._reach: dict[bytes, int] = {}
        for t in sorted(ranks, key=len):
            if len(t) > 3:
                self._reach[t[-4:]] = len(t)
        self._pieces = regex.compile(pattern).findall
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._chunks = TwoAges()
        self._prefixes = TwoAges(PREFIX_ENTRIES)  # asked for chunks that are not known only

    # -- which tokens may stand side by side ---------------------------------

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte.

        They are the last two tokens of its bytes when the final merge is left
        out, found by merging the bytes by rank."""
        if token not in self._halves:
            raw = self.bytes_of[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                at = min(
                    (i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks),
                    key=lambda i: (self.ranks[parts[i] + parts[i + 1]], i),
                )
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes gives [left, right] again.

        Walk back in time from the finished tokens to their bytes, undoing the
        later merge at the seam each time.  The border holds if no pair that
        ever met at the seam could merge while both its sides were alive; of
        equal merges the left one goes first."""
        key = (left, right)
        known = self._beside.get(key)
        if known is not None:
            return known
        ranks, bytes_of = self.ranks, self.bytes_of
        end_a = end_b = len(bytes_of) + 256  # rank of the merge that used a (b) up
        a, b, good = left, right, True
        while True:
            merged = ranks.get(bytes_of[a] + bytes_of[b])
            if merged is not None and merged < end_a and merged <= end_b:
                good = False
                break
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                break
            if hb is None or (ha is not None and a > b):
                end_a, a = a, ha[1]
            else:
                end_b, b = b, hb[0]
        if len(self._beside) >= CACHE_ENTRIES:
            self._beside.clear()
        self._beside[key] = good
        return good

    # -- the table of last tokens --------------------------------------------

    def last_tokens(self, piece: bytes, table: array | None = None) -> array:
        """table[i]: last token of the encoding of piece[:i] (table[0] unused).

        A ``table`` of a shorter prefix of the same piece is extended, which
        makes appends exact; cut a table back to extend it after an edit."""
        table = array("l", [-1]) if table is None else table
        get, reach, beside = self.ranks.get, self._reach.get, self._beside
        for i in range(len(table), len(piece) + 1):
            j = max(0, i - reach(piece[i - 4 : i], 3)) if i > 4 else 0
            for j in range(j, i):
                t = get(piece[j:i])
                if t is not None:
                    if j == 0:
                        break
                    last = table[j]
                    good = beside.get((last, t))
                    if good if good is not None else self.may_follow(last, t):
                        break
            table.append(t)
        return table

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece, from 0 bytes on."""
        table, size = self.last_tokens(piece), {}
        counts = [0]
        for i in range(1, len(piece) + 1):
            t = table[i]
            n = size.get(t) or size.setdefault(t, len(self.bytes_of[t]))
            counts.append(counts[i - n] + 1)
        return counts

    def ids_of(self, prefix: bytes) -> tuple[int, ...]:
        """Ids of a short prefix: an entry of one table for all pieces, the
        prefix before its last token and that token.  Pieces that begin alike
        share entries, and only entries that an encoding asks for are made."""
        known = self._prefixes
        ids = known.get(prefix)
        if ids is None:
            get, beside, new, n = self.ranks.get, self._beside.get, known.new.get, len(prefix)
            t = get(prefix)
            if t is not None:
                ids = (t,)
            else:
                for j in range(max(1, n - self._reach.get(prefix[-4:], 3)), n):
                    t = get(prefix[j:])
                    if t is not None:
                        ids = new(prefix[:j]) or self.ids_of(prefix[:j])
                        good = beside((ids[-1], t))
                        if good if good is not None else self.may_follow(ids[-1], t):
                            break
                ids += (t,)
            known.put(prefix, ids)
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; those of a long piece are read backwards off a table
        of its own."""
        if len(piece) <= PREFIX_BYTES:
            return list(self.ids_of(piece)) if piece else []
        table, i, ids = self.last_tokens(piece), len(piece), []
        while i:
            ids.append(table[i])
            i -= len(self.bytes_of[table[i]])
        return ids[::-1]

    # -- whole texts ---------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        return self._pieces(text)

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers."""
        known, ids = self._prefixes.new.get, []
        for piece in self._pieces(chunk):
            raw = piece.encode("utf-8", "surrogatepass")
            ids += known(raw) or self.encode_piece(raw)
        return array("I", ids).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit integers, one after the
        other.  A piece never crosses a space that stands before a visible
        character, so the text falls into independent chunks there."""
        chunks, parts = self._chunks, CHUNK.split(text) if BLANKS.search(text) else text.split(" ")
        out = list(map(chunks.new.get, parts))
        out[0] = self._packed(parts[0])
        for i in [i for i, ids in enumerate(out) if ids is None]:
            part = parts[i]
            ids = chunks.get(part)
            if ids is None:
                ids = self._packed(" " + part)
                if len(part) <= CACHE_CHARS:
                    chunks.put(part, ids)
            out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(self._raw[np.frombuffer(packed, "<u4")].tolist())


def _bytes_to_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabulary files: visible
    Latin-1 characters stand for themselves, the others count up from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of_tiktoken(content: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def ranks_of_json(content: bytes) -> tuple[dict[bytes, int], list[str]]:
    """Ranks and the special strings of a tokenizer.json with a byte-level BPE.

    The ids of such a file count up in merge order, so they serve as ranks."""
    spec = json.loads(content)
    chars = _bytes_to_chars()
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip or need whole words are not supported")
    vocab = spec["model"]["vocab"]
    order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if order != sorted(order):
        raise ValueError("ids do not follow the order of the merges")
    return {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}, special
