"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, accents and homoglyphs to plain letters,
digit and symbol substitutions to the letters they stand for.  The lexicon has
whole words and word beginnings with weights; some entries may be given, the
rest is learned from labelled texts.  Hits inside an exception phrase do not
count.  The weights found are summed and normalised by length, and a logistic
curve with two inputs turns that into a score from 0 to 1.

Learning is bounded: at most ``SAMPLE`` labelled texts (picked by a hash of
their id, copies left out) and ``ENTRIES`` lexicon entries reach the driver,
whatever the size of the corpus.  Term counts of the sample are made by Spark.

Defined results: null text counts as empty and scores like a text without any
hit; repeated rows are scored each; a document labelled twice counts with its
highest label, labels that are null or belong to no document are ignored;
without labels of both kinds the seed lexicon is used alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.scratch import settle

#: Labelled texts that a model is fitted on at most.
SAMPLE = 20_000
#: Lexicon entries at most.
ENTRIES = 2_000
#: Texts with the label that an entry needs, and its odds against the rest.
SUPPORT, ODDS = 3, 6.0
#: Lengths of the word beginnings that are tried as entries.
STEMS = range(4, 9)
#: Weights of entries known beforehand (fixed values).
SEED = {
    "idiot": 3.0, "moron": 3.0, "scum": 3.0, "loser": 3.0, "stupid": 2.5, "pathetic": 2.5,
    "worthless": 2.5, "disgusting": 2.5, "trash": 2.0, "clown": 2.0,
}
#: Phrases whose hits do not count (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "pond scum", "class clown")

#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Digits and symbols that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LEET_INSIDE = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

_GLYPHS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(LEET)
_INSIDE = re.compile(r"[@$!|€+](?=[^\W_])")
_SYMBOLS = re.compile(r"[@$!|€+]")
_WORDS = re.compile(r"[^\W\d_]+")
_ASCII_WORDS = re.compile(r"[a-z]+")


def folded_words(text: str | None) -> list[str]:
    """Words of a folded text."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        if not t.isascii():
            t = "".join(c for c in t if not unicodedata.combining(c)).translate(_GLYPHS)
    if _SYMBOLS.search(t):
        t = _INSIDE.sub(lambda m: LEET_INSIDE[m[0]], t)
    t = t.translate(_DIGITS)
    return (_ASCII_WORDS if t.isascii() else _WORDS).findall(t)


@dataclass
class Lexicon:
    """``words`` and ``stems`` (word beginnings) to weights; the curve's
    numbers: score = 1 / (1 + exp(-(bias + by_sum x + by_density y)))."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    by_sum: float = 1.0
    by_density: float = 1.0

    def matcher(self) -> ahocorasick.Automaton:
        """Entries with the spaces that hold them to word borders."""
        auto = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            auto.add_word(f" {stem}", (len(stem) + 1, w))
        for word, w in self.words.items():
            auto.add_word(f" {word} ", (len(word) + 2, w))
        for phrase in self.exceptions:
            key = f" {' '.join(folded_words(phrase))} "
            auto.add_word(key, (len(key), None))
        if len(auto):
            auto.make_automaton()
        return auto


def measure(words: list[str], auto: ahocorasick.Automaton) -> tuple[float, float]:
    """(log of the summed weights of hits, weights for each root of a word)."""
    if not words or not len(auto):
        return 0.0, 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in auto.iter(" " + " ".join(words) + " "):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))  # one entry a word
    if spared:
        hits = {s: w for s, w in hits.items() if not any(lo <= s < hi for lo, hi in spared)}
    total = sum(hits.values())
    return math.log1p(total), total / math.sqrt(len(words))


def scorer(lexicon: Lexicon, raw: bool = False):
    """A Column function: text -> score, or with ``raw`` the two inputs."""

    @F.pandas_udf("x double, y double")
    def inputs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = lexicon.matcher()
        for texts in batches:
            yield pd.DataFrame([measure(folded_words(t), auto) for t in texts], columns=["x", "y"])

    if raw:
        return inputs

    def score(text: Column) -> Column:
        both = inputs(text)
        z = F.lit(lexicon.bias) + F.lit(lexicon.by_sum) * both["x"] + F.lit(lexicon.by_density) * both["y"]
        return 1 / (1 + F.exp(-z))

    return score


def _counts(sample: DataFrame) -> DataFrame:
    """(term, a, b): texts of the sample with the term, labelled 1 and 0.
    Whole words end in a space, beginnings do not."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                terms = set()
                for w in set(folded_words(text)):
                    terms.add(w + " ")
                    terms.update(w[:n] for n in STEMS if n <= len(w))
                seen[int(toxic)].update(terms)
            for label, terms in enumerate(seen):
                if terms:
                    yield pd.DataFrame({"term": list(terms), "n": list(terms.values()), "label": label})

    rows = sample.select("text", "toxic").mapInPandas(count, "term string, n long, label int")
    return rows.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"),
    )


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge @ beta), -2, 2)
    return beta


def _without_repeats(found: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """Entries of which none says what another says: a beginning gives way to
    a longer entry that nearly all its texts have, then an entry gives way to
    a beginning of it that has its texts and nearly its weight."""
    longest = dict(found)
    for term, (a, _) in found.items():
        for k in range(min(STEMS), len(term)):
            short = term[:k]
            if short in found and a >= 0.95 * found[short][0]:
                longest.pop(short, None)
    chosen: dict[str, tuple[int, float]] = {}
    for term in sorted(longest, key=len):
        a, w = longest[term]
        shorter = (chosen[term[:k]] for k in range(min(STEMS), len(term)) if term[:k] in chosen)
        if not any(a2 >= a and w2 >= 0.8 * w for a2, w2 in shorter):
            chosen[term] = (a, w)
    return chosen


def learn(
    docs: DataFrame,
    labels: DataFrame,
    use: Column | None = None,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    entries: int = ENTRIES,
    seed: dict[str, float] = SEED,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon and its curve from the labelled documents; ``use`` tests the
    labels' ``doc_id`` and picks those that may be learned from."""
    marked = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)")
    if use is not None:
        marked = marked.withColumnRenamed("_id", "doc_id").filter(use).withColumnRenamed("doc_id", "_id")
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64(F.lit("label"), "_id"), "_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(marked), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min(F.struct("_doc", "text")).alias("r"))
    rows = settle(rows.select("toxic", "r.text"), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Lexicon(dict(seed), exceptions=exceptions)
    counts = _counts(rows).filter(F.col("a") >= SUPPORT)
    p1, p0 = (F.col("a") + 0.5) / (pos + 1), (F.col("b") + 0.5) / (neg + 1)
    ea, eb = ((F.col("a") + F.col("b")) * k / (pos + neg) for k in (pos, neg))
    gain = 2 * (
        F.col("a") * F.log(F.col("a") / ea) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / eb)).otherwise(0.0)
    )
    counts = counts.withColumns({"w": F.log(p1 / p0), "gain": gain}).filter(F.col("w") >= math.log(ODDS))
    counts = settle(counts, "terms")
    # chance alone must not be expected to bring one of the tried terms so far
    bar = 2 * math.log(max(1, counts.count()) + 1) + 12
    best = counts.filter(F.col("gain") >= bar).orderBy(F.desc("gain"), "term").limit(entries).collect()
    chosen = _without_repeats({r["term"]: (r["a"], r["w"]) for r in best})
    words = dict(seed) | {t[:-1]: w for t, (_, w) in chosen.items() if t.endswith(" ")}
    lexicon = Lexicon(words, {t: w for t, (_, w) in chosen.items() if not t.endswith(" ")}, exceptions)
    found = rows.select("toxic", scorer(lexicon, raw=True)("text").alias("m")).select("toxic", "m.*").collect()
    x = np.array([(r["x"], r["y"]) for r in found])
    beta = _fit(x, np.array([r["toxic"] for r in found], "f8"))
    lexicon.bias, lexicon.by_sum, lexicon.by_density = map(float, beta)
    return lexicon


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text, mod 4, is 2: kept from learning."""
    return F.crc32(id.cast("string").cast("binary")) % 4 == 2


def judge(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    scored = docs.select(F.col(id).alias("doc_id"), scorer(lexicon)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    return docs.filter(scorer(lexicon)(F.col(text)) < threshold)
