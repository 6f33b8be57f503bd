"""Phrase collocations against a count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000, percent=80):
    """The definition, phrase by phrase."""
    f = defaultdict(Counter)
    for lang, text in rows:
        own = f["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        phrases = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        within = Counter()
        for p, c in phrases.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], c)
        found = []
        for p, a in phrases.items():
            if 100 * within[p] < percent * a or not within[p]:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "naïve", "日本", "x1", "--", "\xa0", "a\x0cb"] + [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        parts = [rng.choice(words[: rng.choice([3, 8, len(words)])]) for _ in range(rng.randrange(120))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for p in parts)
        out.append((rng.choice(["en", "de", None, ""]), text))
    return out + [("en", None), (None, ""), ("de", "a " * 500), ("en", "of the of the of the new york city " * 60), ("fr", " . , ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, text string, bucket int")


@pytest.mark.parametrize("settings", [{}, {"HOT": 2000, "ROOM": 16}, {"BLOCK_BYTES": 50, "ROOM": 64, "HOT": 400}, {"RANKED": 20}])
def test_equals_brute_force(spark, monkeypatch, settings):
    """Small blocks, many buckets and prefixes that are routed by three and four words."""
    for name, value in settings.items():
        monkeypatch.setattr(collocations, name, value)
    rows = texts(5)
    got = collocations.collocations(frame(spark, rows).repartition(3))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_hot_prefixes_are_routed_by_more_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROOM", 16)
    monkeypatch.setattr(collocations, "HOT", 2000)
    blocks = collocations.suffix_blocks(frame(spark, texts(5)))
    total = blocks.groupBy().sum("n").first()[0]
    routed = collocations.route(blocks, total)
    assert {r.depth for r in routed.select("depth").distinct().collect()} == {2, 3, 4}
    assert routed.selectExpr("sum(n) as n").first().n == total


def test_few_and_top(spark):
    rows = [("en", "big apple. " * 30), ("en", "red apple. " * 29), ("en", "no more")]
    assert [tuple(r) for r in collocations.collocations(frame(spark, rows)).collect()] == [("en", 1, "big apple", 30, 30, 59, 120, 2000000 * 30 // 89)]
    many = texts(9)
    got = collocations.collocations(frame(spark, many), least=5, top=7, percent=60)
    assert sorted(tuple(r) for r in got.collect()) == brute(many, 5, 7, 60)


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, [("en", None), (None, " ., ")])).count() == 0
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("top", [9, 1 << 17])
def test_distinct_suffixes(top):
    """Both ways of packing give the same."""
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 3, 500).astype(np.uint32) for _ in range(4)]
    found, counts = collocations._distinct(keys, top)
    assert Counter(dict(zip(zip(*(k.tolist() for k in found), strict=True), counts.tolist(), strict=True))) == Counter(zip(*(k.tolist() for k in keys), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(*[st.integers(1, 3)] * 2, *[st.integers(0, 3)] * 2), min_size=1, max_size=60), st.integers(1, 6), st.integers(2, 4))
def test_partitions_are_counts(rows, least, whole):
    rows = [(a, b, c, d if c else 0) for a, b, c, d in rows]
    keys = [np.array(k, np.uint32) for k in zip(*rows, strict=True)]
    weights = np.arange(1, len(rows) + 1) % 3 + 1
    got = {}
    for size, at, count in collocations.equal_partitions(keys, keys[0].astype(np.int64) * 4 + keys[1], weights, least, whole):
        for p, n in zip(at, count, strict=True):
            key = rows[p][:size]
            assert key not in got
            got[key] = int(n)
    want = Counter()
    for r, w in zip(rows, weights, strict=True):
        for size in range(2, 5):
            if size == 2 or r[size - 1]:
                want[r[:size]] += int(w)
    assert {p: n for p, n in got.items() if n >= least} == {p: n for p, n in want.items() if n >= least}
    assert all(want[p] == n for p, n in got.items())
