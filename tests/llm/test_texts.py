"""Token counts, BPE, URL rules, toxicity and pseudonyms."""

import base64
import hashlib
import random
import re
import time
from datetime import date

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import bpe, pseudonyms, queries, token_counts, toxicity, url_filter
from kinfold.llm.prefix_bpe import PrefixBpe, TwoAges, ranks_of_json, ranks_of_tiktoken

RANKS_PATH, JSON_PATH = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n \t", "a", "don't  stop\n\n now", "x" * 5000, "日本語 🙂 é", "<|endoftext|> a<|endoftext|>", "1234 ab12", "a \x1c b\x85c"]


@pytest.fixture(scope="module")
def library():
    ranks = ranks_of_tiktoken(open(RANKS_PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return PrefixBpe(ranks_of_tiktoken(open(RANKS_PATH, "rb").read()), P.PATTERN)


@pytest.fixture(scope="module")
def narrow():
    """A coder whose tables overflow all the time."""
    bpe = PrefixBpe(ranks_of_tiktoken(open(RANKS_PATH, "rb").read()), P.PATTERN)
    bpe._prefixes, bpe._chunks = TwoAges(3), TwoAges(2)
    return bpe


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(open(JSON_PATH, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON_PATH)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library(coder, library, text):
    text = text.encode("utf-8", "replace").decode()
    assert coder.encode(text) == library.encode_ordinary(text)
    assert coder.decode_bytes(coder.encode_packed(text)) == text.encode()


def test_last_tokens_extend_and_edit(coder):
    piece = " unbelievably".encode()
    whole = coder.last_tokens(piece)
    assert coder.last_tokens(piece, coder.last_tokens(piece[:5])) == whole
    edited = piece[:7] + b"XYZ"
    assert coder.last_tokens(edited, whole[:8]) == coder.last_tokens(edited)


class Counted(dict):
    """Ranks that count how often they are asked."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def test_pieces_that_begin_alike_share_their_table(library):
    """Each prefix is decided once for all pieces; tables of their own ask more than twice as often."""
    ranks = Counted(ranks_of_tiktoken(open(RANKS_PATH, "rb").read()))
    coder = PrefixBpe(ranks, P.PATTERN)
    rng = random.Random(5)
    starts = ["".join(rng.choices(["th", "en", "tion", "er", "ou", "é", "sh", "and"], k=4)) for _ in range(60)]
    words = [a + b for a in starts for b in ("on", "her", "wh", "ed", "xq", "ti", "ble", "ö")]
    for w in words:
        assert coder.encode(w) == library.encode_ordinary(w)
    shared, ranks.asked = ranks.asked, 0
    for w in words:
        coder.last_tokens(w.encode())
    assert shared * 2 < ranks.asked


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", " \x1c", "'s", "unbelievably", "re", "1234567", "!?!", "é", "🙂", "\u3000", "z" * 60]), max_size=12))
def test_full_tables_give_the_same(narrow, library, parts):
    text = "".join(parts)
    packed = narrow.encode_packed(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert narrow.decode_bytes(packed) == text.encode()


def test_long_pieces_equal_library(coder, library):
    for n in (47, 48, 49, 95, 96, 97, 5000):
        for text in ("unbelievably" * (n // 12 + 1), "é🙂" * n, "9" * n, "ab" * n + " "):
            assert coder.encode(text[:n]) == library.encode_ordinary(text[:n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "re", "<|endoftext|>", "1", "!", "é", "🙂"]), max_size=12))
def test_prefix_counts_equal_library(counter, tokenizer, parts):
    text = "".join(parts)
    counts = counter.prefixes(text)
    assert len(counts) == len(text) + 1
    for i in range(len(text) + 1):
        assert counts[i] == len(tokenizer.encode(text[:i], add_special_tokens=False).ids), repr(text[:i])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "   ", "\n", "\t", "'s", "'ll", "'", "re", "<|endoftext|>", "12", "!!", "é", "🙂", "\x1c", "\u3000"]), max_size=14), st.integers(0, 9))
def test_longest_prefix_equals_library(counter, tokenizer, parts, limit):
    text = "".join(parts)
    counts = [len(tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.longest(text, limit) == (counts[-1], max(i for i, c in enumerate(counts) if c <= limit)), repr(text)
    assert counter.count(text) == counts[-1]


def test_long_runs_are_counted_by_their_tables(counter, tokenizer):
    for text in ("!" * 20_000, " " * 20_000 + "x", "9" * 20_000, "ab\n" * 7000, "=" * 9999 + "<|endoftext|>" * 50):
        began = time.time()
        counts = counter.prefixes(text)
        took = time.time() - began
        assert took < 2, (text[:5], took)
        for i in (1, 17, 5000, len(text) - 1, len(text)):
            assert counts[i] == len(tokenizer.encode(text[:i], add_special_tokens=False).ids)
        fits = np.flatnonzero(counts <= 100)[-1]
        assert counter.longest(text, 100) == (counts[-1], fits)


def test_counts_in_spark(spark, tokenizer):
    rows = token_counts.counted(docs(spark, ODD), JSON_PATH, P.PATTERN, 5, ["doc_id"]).collect()
    for r in rows:
        text = ODD[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        fits = max(i for i in range(min(len(text), 200) + 1) if len(tokenizer.encode(text[:i], add_special_tokens=False).ids) <= 5)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.limit_chars) == (len(text.encode()), n, n > 5, fits)
    table = token_counts.prefix_counts(docs(spark, ODD[4:6]), JSON_PATH, P.PATTERN)
    cut = table.select("text", token_counts.longest_prefix(F.col("prefix_tokens"), 2).alias("n")).collect()
    for r in cut:
        fits = [i for i in range(len(r.text) + 1) if len(tokenizer.encode(r.text[:i], add_special_tokens=False).ids) <= 2]
        assert r.n == max(fits)


def test_op2_and_op6_on_whole_table(spark, small, tokenizer, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, small).collect():
        assert r.n_tokens == len(tokenizer.encode(texts.pop(r.doc_id), add_special_tokens=False).ids)
    assert not texts
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, small).collect():
        text = texts.pop(r.doc_id)
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not texts


def test_encode_decode_round_trip(spark):
    coded = bpe.encode(docs(spark, ODD).withColumn("ids", F.lit(1)), RANKS_PATH, P.PATTERN)
    back = bpe.decode(coded.drop("text"), RANKS_PATH, P.PATTERN).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs(spark, []), RANKS_PATH, P.PATTERN).count() == 0


def test_kept_columns_that_clash(spark):
    rows = docs(spark, ["a b", None]).withColumns({c: F.lit("mine") for c in ("_bpe", "n_tokens", "_made", "_rule", "rule", "host", "url")})
    got = bpe.round_trip(rows, RANKS_PATH, P.PATTERN, ["doc_id", "_bpe", "n_tokens"]).collect()
    assert [(r._bpe, r.n_tokens) for r in sorted(got, key=lambda r: r.doc_id)] == [("mine", 2), ("mine", 0)]
    got = token_counts.counted(rows, JSON_PATH, P.PATTERN, 5, ["doc_id", "_made", "n_tokens"]).collect()
    assert [(r._made, r.n_tokens) for r in sorted(got, key=lambda r: r.doc_id)] == [("mine", 2), ("mine", 0)]
    got = url_filter.judge(rows, [url_filter.Rule("net", "/", False)], ["doc_id", "_rule", "rule", "host"]).collect()
    assert {(r._rule, r.rule, r.host, r.verdict) for r in got} == {("mine", None, "", "allow")}


def test_json_and_tiktoken_vocabularies_agree():
    ranks, special = ranks_of_json(open(JSON_PATH, "rb").read())
    assert special == ["<|endoftext|>"]
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))}


# -- URL rules -----------------------------------------------------------------


def glob_regex(glob):
    return re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", glob)), re.S)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from(["a", "b", "/", "*", "**", "ab", "."]), max_size=30).map("".join), min_size=1, max_size=6),
    st.lists(st.text("ab/.", max_size=40), max_size=6),
)
def test_shift_and_equals_regex(globs, texts):
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    found = url_filter.ShiftAnd(globs).matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == bool(glob_regex(g).fullmatch(t)), (g, t)


def test_many_rules_cross_words():
    globs = [f"*.host{i}.example/path-{i}/**" for i in range(40)]
    auto = url_filter.ShiftAnd(globs)
    assert auto.words > 10
    found = auto.matches([f".www.host{i}.example/path-{i}/x".encode() for i in range(40)])
    assert (found == np.eye(40, dtype=bool)).all()


def test_url_edge_cases(spark):
    urls = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"),
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://net/x", "net", "/x", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?/", "x.net", "", None, "allow"), ("http://foo.com/x.net/", "foo.com", "/x.net/", None, "allow"),
        ("http://x.org/fr/://y", "x.org", "/fr/://y", "org/fr/", "allow"), ("://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://é.net/日\n", "é.net", "/日\n", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.judge(df, queries.RULES, ["page_id"]).collect():
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:], urls[r.page_id]
    assert url_filter.judge(df, [], ["page_id"]).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(df.limit(0), queries.RULES, ["page_id"]).count() == 0


# -- toxicity ------------------------------------------------------------------


def test_folding():
    assert toxicity.folded_words("Y0u 1D!0T, ІDΙОT stüpid$ a@b") == ["you", "idiot", "idiot", "stupid", "aab"]
    assert toxicity.folded_words(None) == [] and toxicity.folded_words(" \n") == []


def test_exceptions_and_length():
    auto = toxicity.Lexicon({"trash": 2.0}, {"idio": 3.0}).matcher()
    hit = lambda t: toxicity.measure(toxicity.folded_words(t), auto)
    assert hit("the trash can") == (0.0, 0.0) and hit("trashy talk")[0] == 0.0
    assert hit("trash talk")[0] > 0 and hit("idiots all")[0] > 0
    assert hit("trash " + "word " * 100)[1] < hit("trash word")[1]


def test_learned_words_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["zuxel", "zuxelo", "zuxeli"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(600, None), (601, ""), (602, "word " * 50_000), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (9999, 1), (2, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, marks, ~toxicity.held_out(F.col("doc_id")))
    out = {r.doc_id: r for r in toxicity.judge(df, lexicon).collect()}
    assert all(out[i].predicted == t for i, t in labels)
    assert out[600].score == out[601].score and out[600].predicted == 0 and 0 <= out[602].score <= 1
    assert toxicity.learn(df, marks.limit(0)).words == toxicity.SEED
    assert toxicity.learn(df.limit(0), marks).words == toxicity.SEED
    assert toxicity.clean(df, lexicon).count() == len(rows) - 120


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op7_toxicity(spark, sf).join(marks, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.02


# -- pseudonyms ----------------------------------------------------------------


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pseudo(spark, texts, key="k"):
    return {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, texts), key).collect()}


def test_formats_stay_valid(spark):
    texts = [
        "card 4111 1111 1111 1111.", "4111111111111112", "call +1 (415) 555-2671 now", "111-555-2671", "123-45-6789", "666-45-6789",
        "10.0.0.1", "300.1.1.1", "1984-02-29", "1999-02-30", "31.12.1999", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00",
        "bob@x.example.com", None, "", "nothing here", "a" * 20000, "+1 (017) 555-7713",
    ]
    out = pseudo(spark, texts)
    changed = {i for i in out if out[i].text != texts[i]}
    assert changed == {0, 2, 4, 6, 8, 10, 11, 13, 18}
    assert luhn(re.sub(r"\D", "", out[0].text)) and re.fullmatch(r"card \d{4} \d{4} \d{4} \d{4}\.", out[0].text)
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} now", out[2].text)
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", out[4].text) and re.fullmatch(r"\+1 \(01\d\) \d{3}-\d{4}", out[18].text)
    assert all(int(x) < 256 for x in out[6].text.split("."))
    assert date.fromisoformat(out[8].text)
    iban = out[11].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[14].text is None and out[14].n_pii == 0 and out[0].n_card == 1
    assert {r.text for r in pseudo(spark, [texts[0]], "other").values()} != {out[0].text}
    assert pseudonyms.pseudonymise(docs(spark, []), "k").count() == 0


def test_permutation_and_linkage(spark):
    days = spark.range(146_097).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pseudonyms.pseudonymise(days.sample(0.05, 3), "k")
    n = out.count()
    assert out.filter("n_date = 1").select("text").distinct().count() == n
    a, b = pseudo(spark, ["x 10.1.2.3 y 10.1.2.3", "10.1.2.3"]).values()
    assert a.text == f"x {b.text} y {b.text}"


def test_op8_removes_planted_values(spark, small):
    out = queries.op8_pseudonyms(spark, small).toPandas()
    assert len(out) == 200 and out.n_pii.sum() > 0
    plans = pseudonyms.pseudonymise(docs(spark, ["a"]), "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plans)


def test_values_with_neighbours(spark):
    card, grouped = "4111111111111111", "4111 1111 1111 1111"
    austria, spain, britain = "AT61 1904 3002 3457 3201", "ES9121000418450200051332", "+44 20 7946 0958"
    cases = {
        f"{card} 12/27": [card], f"{grouped} 123": [grouped], f"2024 {grouped}": [grouped], f"{grouped}-12": [grouped],
        f"{austria} EUR": [austria], f"{austria} WORLDWIDE": [austria], f"{spain} NOW": [spain], f"{austria} 2024 EUR": [austria],
        f"{britain} 2024": [britain], f"{britain} 12": [britain], f"{britain} 2024-05-01": [britain, "2024-05-01"],
        "+33 1 23 45 67 89 2024": ["+33 1 23 45 67 89"], f"{card} {card}": [card, card], f"a {grouped}, 10.0.0.1 b": [grouped, "10.0.0.1"],
    }
    cases |= {f"{card} {i:02}": [card] for i in range(100)}  # some of the 18 digits pass Luhn as well
    texts = list(cases)
    out, values = pseudo(spark, texts), sorted({v for found in cases.values() for v in found})
    alone = {values[i]: r.text for i, r in pseudo(spark, values).items()}
    for i, t in enumerate(texts):
        assert [f.old for f in out[i].finds] == cases[t], (t, out[i].finds)
        want = t
        for old in set(cases[t]):
            want = want.replace(old, alone[old])
        assert out[i].text == want and out[i].n_pii == len(cases[t]), (t, out[i].text)
    assert all(old != new for old, new in alone.items())
