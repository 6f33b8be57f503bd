"""Misspelt countries, number plans, and components with very many links."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from kinfold import constants as K
from kinfold.constants import COUNTRY_ALIASES
from kinfold.functions import contact, number_plan
from kinfold.functions.places import iso_names
from kinfold.operators import components, fuzzy_lookup


def planned(digits, plan):
    """The longest prefix in the list decides."""
    hits = [(len(p), a, b) for p, a, b in plan.entries if digits.startswith(p)]
    if not hits or re.match(K.NORTH_AMERICAN["no_exchange"], digits):
        return False
    _, least, most = max(hits)
    return least <= len(digits) <= most


def test_plan_is_its_longest_prefix(spark):
    rng = random.Random(6)
    own = number_plan.default_plan().with_entries([("1415", 1, 0), ("14155", 11, 11), ("4420", 12, 12), ("999", 5, 6), ("88888888", 9, 9)])
    for plan in (number_plan.default_plan(), own):
        starts = ["", *[p for p, *_ in plan.entries], "14155", "1415", "1999", "1370", "1911", "14152", "8888888"]
        numbers = {rng.choice(starts) + "".join(rng.choice("0123456789") for _ in range(rng.randrange(14))) for _ in range(4000)}
        numbers |= {f"1{area}5551234" for area in range(100, 1000)} | {f"1415{e}1234" for e in range(1000)}
        got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", number_plan.assigned(F.col("n"), plan).alias("ok"))
        assert {r.n: r.ok for r in got.collect()} == {n: planned(n, plan) for n in numbers}
    assert number_plan.Plan(()).pattern() == "^(?!)$"


def test_unassigned_area_codes_fail(spark, tmp_path):
    (tmp_path / "plan.csv").write_text("prefix,least,most\n1212,0,-1\n49151,14,15\n")
    plan = number_plan.read_plan(str(tmp_path / "plan.csv"))
    cases = {
        "(415) 555-1234": ("+14155551234", "+14155551234"), "212-555-0000": ("+12125550000", None), "(195) 555-1234": (None, None), "911-555-1234": (None, None),
        "(296) 555-1234": (None, None), "370 555 1234": (None, None), "555-555-1234": (None, None), "415-911-1234": (None, None), "800-555-1234": ("+18005551234", "+18005551234"),
        "+49 151 12345678": ("+4915112345678", None), "+44 20 7946 0958": ("+442079460958",) * 2, "+83 1 2345 678": (None, None), "+91 98765 4321": (None, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", contact.normalize_phone(F.col("t")).alias("a"), contact.normalize_phone(F.col("t"), plan).alias("b"))
    assert {r.t: (r.a, r.b) for r in rows.collect()} == cases
    with pytest.raises(ValueError):
        plan.with_entries([("+1", 1, 2)])


def left(s, most):
    """Rests of a string by the fewest deletions, from all subsets of letters."""
    out = {s: 0}
    for k in range(1, most + 1):
        for keep in itertools.combinations(range(len(s)), len(s) - k):
            out.setdefault("".join(s[i] for i in keep), k)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[-1] + 1))
    return row[-1]


def allowed(s):
    return 0 if len(s) < 4 else 1 if len(s) < 8 else 2


def resolve(value, names):
    if len(value) < 4:
        return None
    own, ranks = left(value, allowed(value)), {}
    for name, code in names.items():
        both = own.keys() & left(name, allowed(name)).keys()
        for rest in both:
            rank = (max(own[rest], left(name, allowed(name))[rest]), distance(value, name))
            ranks[code] = min(ranks.get(code, rank), rank)
    best = [c for c, r in ranks.items() if r == min(ranks.values())]
    return best[0] if len(best) == 1 else None


def test_lookup_equals_all_pairs(spark):
    rng = random.Random(3)
    names = {"alba": "1", "albania": "2", "armenia": "3", "romania": "4", "san marino": "5", "new zealand": "6", "iran": "7", "iraq": "8", "ém日x": "9", "oman": "1"}
    values = {"", "abc", "irak", "albnia", "zew nealand", "san  marno"}
    for name in names:
        for _ in range(25):
            s = list(name)
            for _ in range(rng.choice([1, 1, 2, 3])):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "n", "z"])
            values.add("".join(s))
    got = fuzzy_lookup.lookup(spark.createDataFrame([(v,) for v in [*values, None]], "value string"), spark.createDataFrame(list(names.items()), "name string, code string"))
    assert {r.value: r.code for r in got.collect()} == {v: c for v in values if (c := resolve(v, names))}


def test_countries_with_misspelt_names(spark):
    cases = {
        "Germany": "DE", " germny ": "DE", "Gremany": "DE", "Untied States": "US", "Netherlnds": "NL", "Swizterland": "CH", "Nwe Zealnd": "NZ", "usa": "US", "IND": "IN",
        "planet mars": None, "Indiana": None, "atlantis": None, "xx": None, "": None, None: None, "irak": None, "Phillipines": "PH", "Brasil": "BR",
    }
    rows = spark.createDataFrame([(i, c, "kept") for i, c in enumerate(cases)], "_raw long, country string, code string")
    got = {r._raw: r for r in fuzzy_lookup.with_country(rows).collect()}
    assert {c: got[i].country for i, c in enumerate(cases)} == cases and {r.code for r in got.values()} == {"kept"}
    assert fuzzy_lookup.with_country(rows.limit(0)).count() == 0


def test_no_country_is_mistaken_for_another(spark):
    """Every ISO name and alias still gives its own code."""
    known = {**iso_names(), **COUNTRY_ALIASES}
    rows = spark.createDataFrame(list(known.items()), "country string, want string")
    assert fuzzy_lookup.with_country(rows).filter("country is null or country <> want").count() == 0


def plain_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [0, 777, 10**6])
def test_a_star_with_half_of_all_links(spark, hub):
    rng = random.Random(hub)
    links = [(hub, 1000 + i) for i in range(6000)] + [(20_000 + rng.randrange(9000), 20_000 + rng.randrange(9000)) for _ in range(6000)]
    rows = spark.createDataFrame([x if rng.random() < 0.5 else x[::-1] for x in links], "a long, b long").repartition(8)
    got = {r.node: r.component for r in components.connected_components(rows).collect()}
    assert got == plain_components([x for x in links if x[0] != x[1]])


def test_links_of_a_hub_are_not_shuffled(spark):
    """The hub's links stay in their tasks: the sort-merge part has none of them."""
    edges = spark.range(30_000).select(F.lit(0).cast("long").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.range(30_000).select((F.col("id") + 50_000).alias("u"), (F.col("id") + 10).alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = components._with_low(edges.repartition(6), 60_000)
        sizes = [r.n for r in near.filter("u = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert near.count() == 60_000 and near.filter("u = 0 and low <> 1").count() == 0
    assert len(sizes) >= 6 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
