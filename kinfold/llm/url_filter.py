"""URL rules as a bit-parallel wildcard automaton.

All glob rules are packed into multiword Shift-And masks: one bit for each
consumed token of each rule.  A batch of canonical URLs is run through the
automaton together, one byte column at a time, so a step costs a few vector
operations for all URLs and all rules.

Globs know ``*`` (any run of bytes without ``/``) and ``**`` (any run).  The
canonical URL is ``.`` + host + path, so the rule ``net/`` for a host and all
its subdomains is the glob ``*.net/**``.

Defined results: a URL that is null or has no ``://`` has an empty host and
path and matches no host rule; an empty rule list matches nothing; of equally
long rules that match, the first one given wins; rows are judged one by one,
repeated or not; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.names import fresh

ANY, SEGMENT = "**", "*"


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host, its subdomains and the paths below ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class ShiftAnd:
    """Masks of a list of globs, and their simulation over batches of texts."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        width = sum(map(len, tokens))
        self.words = max(1, -(-width // 64))
        self.start = np.zeros(self.words, "u8")
        step = np.zeros((256, self.words), "u8")  # bits that this byte may move into
        loop = np.zeros((256, self.words), "u8")  # bits that this byte may stay in
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for literal in tokens:
            for byte, gap in literal:
                word, bit = divmod(at, 64)
                mask = np.uint64(1) << np.uint64(bit)
                if byte is None:
                    self.start[word] |= mask
                else:
                    step[byte, word] |= mask
                if gap:
                    loop[:, word] |= mask
                    if gap == SEGMENT:
                        loop[ord("/"), word] &= ~mask
                last = (word, mask)
                at += 1
            self.final.append(last)
        self.step, self.loop = step, loop

    @staticmethod
    def _tokens(glob: str) -> list[tuple[int | None, str]]:
        """(byte, gap behind it); the first entry, without a byte, is the start."""
        out: list[tuple[int | None, str]] = [(None, "")]
        raw = glob.encode()
        i = 0
        while i < len(raw):
            if raw[i : i + 1] == b"*":
                gap = ANY if raw[i : i + 2] == b"**" else SEGMENT
                out[-1] = (out[-1][0], ANY if ANY in (gap, out[-1][1]) else SEGMENT)
                i += len(gap)
            else:
                out.append((raw[i], ""))
                i += 1
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text x glob, whole texts."""
        lengths = np.fromiter(map(len, texts), "i8", len(texts))
        found = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort(-lengths, kind="stable")  # the texts still running are a prefix
        flat = np.frombuffer(b"".join(texts), "u1")
        begin = (np.cumsum(lengths) - lengths)[order]
        length = lengths[order]
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        running = len(texts)
        for i in range(int(length[0]) + 1 if len(texts) else 0):
            alive = int(np.searchsorted(-length, -i, side="right"))  # length >= i
            ended = int(np.searchsorted(-length, -i, side="left"))  # length > i
            for r, (word, mask) in enumerate(self.final):
                found[order[ended:alive], r] = (state[ended:alive, word] & mask) != 0
            running = ended
            if not running:
                break
            byte = flat[begin[:running] + i]
            now = state[:running]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state = (moved & self.step[byte]) | (now & self.loop[byte])
        return found


def longest_rule(rules: list[Rule]):
    """A Column function: canonical URL -> index of the longest rule that
    matches (of equals the first), -1 if none does."""
    ranked = sorted(range(len(rules)), key=lambda r: (-len(rules[r].name), r))
    globs = [rules[r].glob for r in ranked]

    @F.pandas_udf("int")
    def index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ShiftAnd(globs)
        ids = np.array([*ranked, -1], "i4")
        for urls in batches:
            hit = automaton.matches([u.encode("utf-8", "surrogatepass") for u in urls])
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if globs else np.full(len(urls), 0)
            yield pd.Series(ids[first])

    return index


def judge(pages: DataFrame, rules: list[Rule], keep: list[str | Column], url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` plus host, path, rule (name of the rule that decides, else
    null) and verdict (``default`` where none does); a kept column named like one
    of these gives way to it."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    given = pages.select(*keep)
    (hit,) = fresh([*given.columns, "host", "path"], "rule")
    kept = [c for c in given.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    part_host, part_path = fresh(given.columns, "host", "path")
    rows = pages.select(*keep, host.alias(part_host), path.alias(part_path))
    rows = rows.select(*kept, F.col(part_host).alias("host"), F.col(part_path).alias("path"))
    rows = rows.withColumn(hit, longest_rule(rules)(F.concat(F.lit("."), "host", "path")))
    names, verdicts = F.lit(None).cast("string"), F.lit(default)
    for r, rule in enumerate(rules):
        names = F.when(F.col(hit) == r, F.lit(rule.name)).otherwise(names)
        verdicts = F.when(F.col(hit) == r, F.lit("allow" if rule.allow else "block")).otherwise(verdicts)
    return rows.withColumns({"rule": names, "verdict": verdicts}).drop(hit)
