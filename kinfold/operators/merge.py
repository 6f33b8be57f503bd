"""One profile from the records of an entity.

Records count in the order of their source's priority, then of input.  All
rules are aggregations with partial sums: scalars are ``min_by`` over that
order, lists and histories are grouped by value before they are gathered, so a
large entity gathers its distinct values only.  The exception is provenance,
which by definition keeps every record; ``provenance_table`` has it as rows.

Most entities are a few records.  ``merged`` gathers those of up to ``FEW`` items,
once and in order, and applies the rules to arrays; the others go through cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import constants as K
from kinfold.functions.ids import entity_id
from kinfold.functions.text import distinct_by, strip

from .salting import heavy_join
from .scratch import settle

SCALARS = ("full_name", "headline", "years_experience", "city", "region", "country", "linkedin", "github", "portfolio")
LISTS = ("emails", "phones", "other_links")
#: Records, list items, entries, skills and marks of an entity that is merged as arrays.
FEW = 400


def priority(source_type: Column) -> Column:
    out = F.lit(0)
    for kind, p in K.PRIORITY.items():
        out = F.when(source_type == kind, F.lit(p)).otherwise(out)
    return out


def ordered(records: DataFrame) -> DataFrame:
    """Records with ``ord``: smaller counts first."""
    return records.withColumn("ord", F.struct((-priority(F.col("source_type"))).alias("p"), F.col("seq").alias("s")))


def first_value(value: Column, order: Column, present: Column | None = None) -> Column:
    """Aggregate: the present value that comes first (not null, by default)."""
    return F.min_by(value, F.when(value.isNotNull() if present is None else present, order))


def gathered(order: Column, value: Column) -> Column:
    """Aggregate: values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def merge_scalars(rows: DataFrame, names: tuple[str, ...] = SCALARS, by: str = "component") -> DataFrame:
    """The first value of each column; empty strings are values."""
    return rows.groupBy(by).agg(*[first_value(F.col(n), F.col("ord")).alias(n) for n in names])


def merge_lists(rows: DataFrame, names: tuple[str, ...] = LISTS, by: str = "component") -> DataFrame:
    """Ordered unions without regard to case, first spelling kept."""
    parts = F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(F.col(n), F.array().cast("array<string>")).alias("items")) for n in names])
    items = rows.select(by, "ord", F.explode(parts).alias("p")).select(by, "ord", "p.kind", F.posexplode("p.items").alias("pos", "v"))
    items = items.filter(F.col("v").isNotNull()).withColumn("o", F.struct("ord", "pos"))
    unique = items.groupBy(by, "kind", F.lower("v").alias("k")).agg(F.min("o").alias("o"), F.min_by("v", "o").alias("v"))
    lists = unique.groupBy(by).agg(*[gathered(F.when(F.col("kind") == n, F.col("o")), F.when(F.col("kind") == n, F.col("v"))).alias(n) for n in names])
    return lists.select(by, *[F.filter(n, lambda x: x.isNotNull()).alias(n) for n in names])


def merge_entries(rows: DataFrame, name: str, fields: tuple[str, ...], key: tuple[str, ...], by: str = "component") -> DataFrame:
    """Histories: entries of one key become one, in order of first appearance;
    gaps (null or empty) are filled from the next entry that has the field."""
    items = rows.select(by, "ord", F.posexplode(name).alias("pos", "e")).select(by, F.struct("ord", "pos").alias("o"), "e.*")
    parts = [F.lower(strip(F.coalesce(F.col(k), F.lit("")))) for k in key]
    merged = items.groupBy(by, F.concat_ws("|", *parts).alias("k")).agg(
        F.min("o").alias("o"), *[first_value(F.col(f), F.col("o"), F.col(f) != "").alias(f) for f in fields]
    )
    return merged.groupBy(by).agg(gathered(F.col("o"), F.struct(*fields)).alias(name))


def merge_skills(rows: DataFrame, by: str = "component") -> DataFrame:
    """Skills by lower-case name: distinct sources in order, the mean of their
    base confidences plus a boost for each further source, sorted by name."""
    marks = F.filter("provenance", lambda p: p["field"] == "skills")
    base = F.coalesce(F.get(marks, 0)["confidence"], F.lit(K.SKILL_BASE))
    items = rows.select(by, "ord", "source_file", base.alias("base"), F.posexplode("skills").alias("pos", "name"))
    items = items.withColumn("k", F.lower("name")).withColumn("o", F.struct("ord", "pos"))
    spelled = first_value(F.col("name"), F.col("o"), F.col("name") != F.col("k"))
    sources = items.groupBy(by, "k", "source_file").agg(
        F.min("o").alias("o"), F.min_by("base", "o").alias("base"), spelled.alias("name"),
        F.min(F.when(F.col("name") != F.col("k"), F.col("o"))).alias("no"),
    )
    per = sources.groupBy(by, "k").agg(
        gathered(F.col("o"), F.struct("source_file", "base")).alias("from"),  # one entry a file
        F.coalesce(F.min_by("name", "no"), F.col("k")).alias("name"),
    )
    n = F.size("from")
    mean = F.aggregate("from", F.lit(0.0), lambda a, x: a + x["base"]) / n
    conf = F.round(F.least(mean + F.least(F.lit(K.SKILL_BOOST) * (n - 1), F.lit(K.SKILL_BOOST_CAP)), F.lit(1.0)), 4)
    skill = F.struct("name", conf.alias("confidence"), F.transform("from", lambda x: x["source_file"]).alias("sources"))
    return per.select(by, "k", skill.alias("s")).groupBy(by).agg(gathered(F.col("k"), F.col("s")).alias("skills"))


def provenance_table(rows: DataFrame, by: str = "component") -> DataFrame:
    """(component, ord, pos, field, source, method, confidence), a row a mark."""
    return rows.select(by, "ord", F.posexplode("provenance").alias("pos", "p")).select(by, "ord", "pos", "p.*")


def merge_decisions(rows: DataFrame, names: tuple[str, ...] = SCALARS, by: str = "component") -> DataFrame:
    """(component, field, winner_source, loser_sources, reason) of scalar fields
    with a value: an audit table that the profile itself does not carry."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).isNotNull().alias("has")) for n in names])
    items = rows.select(by, "ord", "source_file", F.explode(parts).alias("p")).filter("p.has").select(by, "p.field", "ord", "source_file")
    # one row a source file: its best record, and how many it has
    per = items.groupBy(by, "field", "source_file").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    best = per.groupBy(by, "field").agg(gathered(F.col("ord"), F.struct("source_file", "ord.p")).alias("all"), F.sum("n").alias("n"))
    losers = F.transform(F.slice("all", F.lit(2), F.greatest(F.size("all"), F.lit(1))), lambda x: x["source_file"])
    ranks = F.array_distinct(F.transform("all", lambda x: (-x["p"]).cast("string")))
    reason = F.when(F.col("n") == 1, F.lit("single source")).otherwise(F.concat(F.lit("priority: "), F.array_join(ranks, " > ")))
    return best.select(by, "field", F.get("all", F.lit(0))["source_file"].alias("winner_source"), losers.alias("loser_sources"), reason.alias("reason"))


def _cell(order: Column, kind: str, key: Column, pos: Column, value: Column, sub: Column | None = None, number: Column | None = None, parts: Column | None = None) -> Column:
    """A cell: what it is (kind, key, sub), where it stands and what it holds."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), (none("string") if sub is None else sub).alias("sub"),
        F.struct(order["p"].alias("p"), order["s"].alias("s"), pos.cast("int").alias("pos")).alias("o"), value.cast("string").alias("v"),
        (none("double") if number is None else number).alias("x"), (none("array<string>") if parts is None else parts).alias("parts"),
    )


ENTRIES = {
    "experience": (("company", "title", "start", "end", "summary"), ("company", "title")),
    "education": (("institution", "degree", "field", "end_year"), ("institution", "degree")),
}
_WIDTH = max(len(fields) for fields, _ in ENTRIES.values())


def cells(rows: DataFrame, by: str = "component", provenance: bool = True) -> DataFrame:
    """Ordered records as rows (by, kind, key, sub, o, v, x, parts): one for each
    record, scalar with a value, list item, entry, skill and mark.  Marks come as what
    their field scores from and, with ``provenance``, as themselves."""
    order, at, none = F.col("ord"), F.lit(0), F.lit(None).cast("string")
    own = [F.array(_cell(order, "record", F.lit(""), at, none), *[_cell(order, "scalar", F.lit(n), at, F.col(n)) for n in SCALARS])]
    for n in LISTS:
        own.append(F.transform(n, _list_cell(order, n)))
    for n, (fields, key) in ENTRIES.items():
        own.append(F.transform(n, _entry_cell(order, n, fields, key)))
    marks = F.filter("provenance", lambda p: p["field"] == "skills")
    base = F.coalesce(F.get(marks, 0)["confidence"], F.lit(K.SKILL_BASE))
    own.append(F.transform("skills", lambda v, i: _cell(order, "skills", F.lower(v), i, v, F.col("source_file"), base)))
    own.append(F.transform("provenance", lambda p, i: _cell(order, "score", F.substring_index(p["field"], ".", 1), i, none, p["source"], p["confidence"])))
    if provenance:
        mark = lambda p, i: _cell(order, "provenance", F.concat_ws(":", order["s"], i), i, none, None, p["confidence"], F.array(p["field"], p["source"], p["method"]))
        own.append(F.transform("provenance", mark))
    empty = F.filter(own[0], lambda c: F.lit(False))
    all_cells = F.concat(*[F.coalesce(c, empty) for c in own])
    out = rows.select(by, F.explode(all_cells).alias("c")).select(by, "c.*")
    return out.filter(F.col("v").isNotNull() | ~F.col("kind").isin("scalar", *LISTS))


def _list_cell(order: Column, kind: str):
    return lambda v, i: _cell(order, kind, F.lower(v), i, v)


def _entry_cell(order: Column, kind: str, fields: tuple[str, ...], key: tuple[str, ...]):
    def made(e: Column, i: Column) -> Column:
        name = F.concat_ws("|", *[F.lower(strip(F.coalesce(e[k], F.lit("")))) for k in key])
        return _cell(order, kind, name, i, F.lit(None), parts=F.array(*[e[f] for f in fields]))

    return made


def resolve(records: DataFrame, by: str = "component", provenance: bool = True, scores: tuple[str, ...] = ()) -> DataFrame:
    """A profile for each entity, in the profile schema plus ``component``;
    overall_confidence is left 0.  Without ``provenance`` that column is left
    out and no entity's marks are gathered.  ``scores`` names top-level fields
    whose confidence comes along as _score_<field>.

    Records become cells once; cells of one source, then of one key, then of one
    entity are combined, with partial sums before each of the three shuffles."""
    o, v, x, kind = F.col("o"), F.col("v"), F.col("x"), F.col("kind")
    spelled = F.when((kind == "skills") & (v != F.col("key")), o)
    parts = [F.get("parts", F.lit(i)) for i in range(_WIDTH)]
    one = cells(ordered(records), by, provenance).groupBy(by, "kind", "key", "sub").agg(
        F.min("o").alias("o"), F.min_by("v", "o").alias("v"), F.max("x").alias("most"), F.min_by("x", "o").alias("x"),
        F.min_by("v", spelled).alias("name"), F.min(spelled).alias("no"),
        *[F.min_by(p, F.when((kind == "provenance") | (p != ""), o)).alias(f"f{i}") for i, p in enumerate(parts)],
    )
    source = F.when(kind == "skills", F.struct("o", F.struct("sub", "x").alias("v")))
    keyed = one.groupBy(by, "kind", "key").agg(
        F.min("o").alias("o"), F.min_by("v", "o").alias("v"), F.min_by("x", "o").alias("x"), F.array_sort(F.collect_list(source)).alias("from"),
        F.coalesce(F.min_by("name", "no"), F.col("key")).alias("name"), (F.max("most") + F.lit(K.CORROBORATION) * (F.count("sub") - 1)).alias("score"),
        *[F.min_by(f"f{i}", "o").alias(f"f{i}") for i in range(_WIDTH)],
    )
    n = F.size("from")
    mean = F.aggregate("from", F.lit(0.0), lambda a, s: a + s["v"]["x"]) / F.greatest(n, F.lit(1))  # cells of other kinds have none
    conf = F.round(F.least(mean + F.least(F.lit(K.SKILL_BOOST) * (n - 1), F.lit(K.SKILL_BOOST_CAP)), F.lit(1.0)), 4)
    sorted_by = F.when(kind == "skills", F.col("key")).otherwise("")
    cell = F.struct("kind", sorted_by.alias("k"), "o", "v", "x", "name", conf.alias("conf"), F.col("from.v.sub").alias("sources"), *[f"f{i}" for i in range(_WIDTH)])
    value = lambda name: F.max(F.when((kind == "scalar") & (F.col("key") == name), v))
    scored = [F.max(F.when((kind == "score") & (F.col("key") == s), F.least("score", F.lit(1.0)))).alias(f"_score_{s}") for s in scores]
    out = keyed.groupBy(by).agg(
        *[value(name).alias(name) for name in SCALARS], *scored, F.array_sort(F.collect_list(F.when(~kind.isin("record", "scalar", "score"), cell))).alias("_cells")
    )
    of = lambda name, made: F.transform(F.filter("_cells", lambda c: c["kind"] == name), made)
    entry = lambda fields: lambda c: F.struct(*[c[f"f{i}"].alias(f) for i, f in enumerate(fields)])
    lists = {name: of(name, lambda c: c["v"]) for name in LISTS}
    lists["skills"] = of("skills", lambda c: F.struct(c["name"].alias("name"), c["conf"].alias("confidence"), c["sources"].alias("sources")))
    lists |= {name: of(name, entry(fields)) for name, (fields, _) in ENTRIES.items()}
    if provenance:
        lists["provenance"] = of("provenance", lambda c: F.struct(c["f0"].alias("field"), c["f1"].alias("source"), c["f2"].alias("method"), c["x"].alias("confidence")))
    return _profile(out.withColumns(lists), by, provenance, scores)


def _profile(out: DataFrame, by: str, provenance: bool, scores: tuple[str, ...]) -> DataFrame:
    marks = ["provenance"] if provenance else []
    out = out.withColumn("years_experience", F.col("years_experience").cast("double"))
    return out.select(
        by, entity_id(F.col("full_name"), F.col("emails"), F.col("phones")).alias("candidate_id"), "full_name", "emails", "phones",
        F.struct("city", "region", "country").alias("location"),
        F.struct("linkedin", "github", "portfolio", F.col("other_links").alias("other")).alias("links"),
        "headline", "years_experience", "skills", "experience", "education", *marks, F.lit(0.0).alias("overall_confidence"), *[f"_score_{s}" for s in scores],
    )


def _entry_arrays(items: Column, fields: tuple[str, ...], key: tuple[str, ...]) -> Column:
    """Entries with their key ``k``; empty fields are null."""
    name = lambda e: F.concat_ws("|", *[F.lower(strip(F.coalesce(e[k], F.lit("")))) for k in key])
    return F.transform(items, lambda e: F.struct(name(e).alias("k"), *[F.nullif(e[f], F.lit("")).alias(f) for f in fields]))


def _filled(entries: Column, keys: Column, fields: tuple[str, ...]) -> Column:
    """One entry a key, each field from the first that has it."""
    first = lambda k, f: F.get(F.filter(entries, lambda e: (e["k"] == k) & e[f].isNotNull()), 0)[f]
    merged = F.transform(F.array_distinct(keys), lambda k: F.struct(*[first(k, f).alias(f) for f in fields]))
    plain = F.transform(entries, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(entries), plain).otherwise(merged)


def _skill(items: Column, k: Column) -> Column:
    """The skill of a key from items (k, name, file, base) in order."""

    def made(mine: Column) -> Column:
        files = F.transform(mine, lambda x: x["file"])
        one = F.filter(mine, lambda x, i: F.array_position(files, x["file"]) == i + 1)  # the first of each file
        n, total = F.size(one), F.aggregate(one, F.lit(0.0), lambda a, x: a + x["base"])
        conf = F.least(total / n + F.least(F.lit(K.SKILL_BOOST) * (n - 1), F.lit(K.SKILL_BOOST_CAP)), F.lit(1.0))
        name = F.get(F.filter(mine, lambda x: x["name"] != k), 0)["name"]
        return F.struct(F.coalesce(name, k).alias("name"), F.round(conf, 4).alias("confidence"), F.transform(one, lambda x: x["file"]).alias("sources"))

    return F.get(F.transform(F.array(F.filter(items, lambda x: x["k"] == k)), made), 0)  # found once


def resolve_few(records: DataFrame, by: str = "component", provenance: bool = True, scores: tuple[str, ...] = ()) -> DataFrame:
    """What ``resolve`` gives, from the records of an entity gathered in order: one
    shuffle.  No file or skill is null."""
    marks = F.filter("provenance", lambda p: p["field"] == "skills")
    base = F.coalesce(F.get(marks, 0)["confidence"], F.lit(K.SKILL_BASE))
    names = [*SCALARS, *LISTS, *ENTRIES, "skills", "provenance"]
    one = ordered(records).withColumn("base", base).select(by, F.struct("ord", "source_file", "base", *names).alias("r"))
    rows = one.groupBy(by).agg(F.array_sort(F.collect_list("r")).alias("r"))
    every = lambda n: F.flatten(F.array_compact(F.col(f"r.{n}")))
    items = lambda r: F.transform(r["skills"], lambda v: F.struct(F.lower(v).alias("k"), v.alias("name"), r["source_file"].alias("file"), r["base"].alias("base")))
    top = lambda p: F.struct(F.substring_index(p["field"], ".", 1).alias("top"), p["source"].alias("source"), p["confidence"].alias("x"))
    rows = rows.withColumns(
        {f"_{n}": F.array_compact(every(n)) for n in LISTS} | {f"_{n}": _entry_arrays(every(n), fields, key) for n, (fields, key) in ENTRIES.items()}
        | {"_skills": F.flatten(F.array_compact(F.transform("r", items))), "_marks": F.transform(every("provenance"), top)}
    )

    def score(mine: Column) -> Column:
        sources = F.size(F.array_distinct(F.array_compact(F.transform(mine, lambda m: m["source"]))))
        return F.when(F.size(mine) > 0, F.least(F.array_max(F.transform(mine, lambda m: m["x"])) + F.lit(K.CORROBORATION) * (sources - 1), F.lit(1.0)))

    of = lambda s: F.filter("_marks", lambda m: m["top"] == s)
    out = {n: F.get(F.array_compact(F.col(f"r.{n}")), 0) for n in SCALARS} | {n: distinct_by(F.col(f"_{n}"), F.lower) for n in LISTS}
    out |= {n: _filled(F.col(f"_{n}"), F.col(f"_{n}.k"), fields) for n, (fields, _) in ENTRIES.items()}
    out["skills"] = F.transform(F.array_sort(F.array_distinct(F.col("_skills.k"))), lambda k: _skill(F.col("_skills"), k))
    out |= {f"_score_{s}": F.get(F.transform(F.array(of(s)), score), 0) for s in scores}
    if provenance:
        out["provenance"] = F.transform(every("provenance"), lambda p: F.struct(*[p[n].alias(n) for n in ("field", "source", "method", "confidence")]))
    return _profile(rows.select(by, *[c.alias(n) for n, c in out.items()]), by, provenance, scores)


def merged(records: DataFrame, by: str = "component", provenance: bool = True, scores: tuple[str, ...] = ()) -> DataFrame:
    """``resolve``, but entities of up to ``FEW`` items are merged as arrays.  The
    records should be settled, as they are read once more for the sizes."""
    items = F.lit(1).cast("long")
    for n in (*LISTS, *ENTRIES, "skills", "provenance"):
        items = items + F.coalesce(F.array_size(n), F.lit(0))
    odd = F.col("source_file").isNull() | F.coalesce(F.exists("skills", lambda v: v.isNull()), F.lit(False))
    weight = F.when(odd, items + FEW).otherwise(items)
    large = settle(records.groupBy(by).agg(F.sum(weight).alias("_items"), F.count("*").alias("_n")).filter(F.col("_items") > FEW).drop("_items"), "large-entities")
    if large.isEmpty():
        return resolve_few(records, by, provenance, scores)
    sized = settle(heavy_join(records, large, [by], "_n", records.count(), how="left"), "sized")
    few, many = sized.filter("_n is null").drop("_n"), sized.filter("_n is not null").drop("_n")
    return resolve_few(few, by, provenance, scores).unionByName(resolve(many, by, provenance, scores))
