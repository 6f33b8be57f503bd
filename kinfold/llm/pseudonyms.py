"""Format-preserving pseudonyms for personal data, as DataFrame expressions.

One regular expression finds e-mail addresses, card numbers, phone numbers,
IBANs, US social security numbers, IPv4 addresses and dates.  A find must be
valid (check digits, lengths, number plan, calendar).  A card, phone or IBAN
that is not is tried again without its last groups, as what stands behind a
value may look like a part of it: usual lengths first, then the longest.  Finds
may start at every place of a text that no valid value before has taken, so what
a find leaves, or a find that is not valid at all, can hold others.  The value is
then permuted inside the set of valid values of its format by a keyed Feistel
network, so equal values have equal pseudonyms in all documents, different
values have different ones, and separators stay where they were.

A Feistel round adds a keyed hash of one half to the other half, modulo that
half's size; halves need not be equally large.  Domains are written as
products, so no cycle walking is needed:

* dates of the 400 years from 1800, days up to 12 (240 x 240 of them) and later
  ones (9 x 9,833) each among themselves: the pseudonym of 09/28/1995 is that of
  1995-09-28 and 28/09/1995 however it is written, and a spelling that shows which
  number is the day still does, so different dates never meet in one spelling;
* phones of the North American plan: area x (exchange, line) = 800 x 8,000,000;
* social security numbers: 898 areas x (99 groups x 9,999 serials);
* IPv4: 65,536 x 65,536; cards and IBANs: the digits but for check digits,
  halved (a card keeps its first digit), after which check digits are set anew;
* e-mail: the local part becomes a keyed digest of 96 bits, the domain stays.

Laws of the formats: a local part has at most 255 characters and a host at most
126 names below its last, of 63 characters each (that is what 253 characters can
hold); longer ones are no addresses and stay.  No pattern repeats a group without
such a bound, so no text, however long, makes the matcher recurse deeply.  Left
alone on purpose: social security numbers without their hyphens, IPv6 addresses,
numbers inside of identifiers (a letter beside them, or an underscore before).

Defined results: a null text stays null, with zero finds; empty texts and texts without
finds stay as they are; repeated rows get equal results; other columns pass
through, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.names import fresh

ROUNDS = 8
#: Finds of a text that are worked on together.
RUN = 256
KINDS = ("email", "iban", "ip", "ssn", "date", "card", "phone")

#: Letters of alphabets whose words stand apart, beside A-Z: Latin, Greek, Cyrillic, and their marks.
_LETTERS = r"\u00C0-\u024F\u0300-\u04FF\u1E00-\u1FFF"
#: What each kind looks like, in the order in which they are tried.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9{_LETTERS}])[A-Za-z0-9{_LETTERS}][A-Za-z0-9{_LETTERS}._%+'-]{{0,254}}+@"
    r"(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_]|-[0-9])",
    "date": r"(?<![A-Za-z0-9_/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![A-Za-z0-9_/]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9_])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9]|-[0-9])"
    r"|(?<![A-Za-z0-9_])\+(?!1[^0-9])[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,12}+(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9_-])(?=[0-9]{2})[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_]|-[0-9])",
}
FINDER = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Characters of an IBAN by country; other countries may have any number.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits of a phone number, calling code included, in plans of one length.
PHONE_LENGTHS = {"1": 11, "7": 11, "31": 11, "32": 11, "33": 11, "34": 11, "41": 11, "44": 12, "47": 10, "48": 11, "61": 11, "86": 13, "91": 12}


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 keyed bits."""
    word = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(word, 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (a, b)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        h = _hash(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, (s["l"] + h) % s["a"]).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + h) % s["b"]).alias("r"),
            s["a"].alias("a"), s["b"].alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _part(x: Column, at: int | Column, n: int | Column) -> Column:
    at, n = (v if isinstance(v, Column) else F.lit(v) for v in (at, n))
    return F.substring(x, at, n).try_cast("long")


def _pad(x: Column, n: int | Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _refill(x: Column, digits: Column) -> Column:
    """x with its digits replaced, in order, by those of ``digits``."""
    def one(i: Column) -> Column:
        upto = F.length(_digits(F.substring(x, F.lit(1), i)))
        c = F.substring(x, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, upto, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), one), "")


def _half_digits(key: str, kind: str, d: Column) -> Column:
    """A string of 2 to 30 digits permuted within its length."""
    n = F.length(d)
    n1 = F.floor(n / 2).cast("int")
    n2 = n - n1
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    return F.transform(
        F.array(feistel(key, kind, _part(d, F.lit(1), n1), _part(d, n1 + 1, n2), ten(n1), ten(n2))),
        lambda s: F.concat(_pad(s["l"], n1), _pad(s["r"], n2)),
    )[0]


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _mod97(country: Column, check: Column, bban: Column) -> Column:
    """Remainder of an IBAN with its head moved to the end."""
    whole = F.concat(bban, country, check)

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(whole, "(?<=.)(?=.)"), F.lit(0), add)


def _card(key: str, x: Column) -> tuple[Column, Column]:
    d = _digits(x)
    n = F.length(d)
    body = F.concat(F.substring(d, F.lit(1), F.lit(1)), _half_digits(key, "card", F.substring(d, F.lit(2), n - 2)))
    new = F.transform(F.array(body), lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return n.between(13, 19) & ~d.rlike("^0") & (_luhn(d) % 10 == 0), _refill(x, new)


def _phone(key: str, x: Column) -> tuple[Column, Column]:
    """Numbers of the North American plan stay in it; any other number with a
    plus sign and 8 to 15 digits keeps its first three digits, or five where only
    the fifth (0 or 1 at the start of an exchange) tells it from that plan."""
    d = _digits(x)
    n = F.length(d)
    local = F.substring(d, n - 9, F.lit(10))
    plan = F.when(x.startswith("+"), (n == 11) & d.startswith("1")).otherwise(n == 10) & local.rlike("^[2-9][0-9]{2}[2-9]")
    s = feistel(key, "phone", _part(local, 1, 3) - 200, _part(local, 4, 7) - 2_000_000, F.lit(800), F.lit(8_000_000))
    north = F.transform(F.array(s), lambda s: F.concat(F.substring(d, F.lit(1), n - 10), _pad(s["l"] + 200, 3), _pad(s["r"] + 2_000_000, 7)))[0]
    fixed = F.when((n == 11) & d.rlike("^1[2-9]"), 5).otherwise(3)
    other = F.concat(F.substring(d, F.lit(1), fixed), _half_digits(key, "abroad", F.substring(d, fixed + 1, n - fixed)))
    return plan | (x.startswith("+") & n.between(8, 15)), _refill(x, F.when(plan, north).otherwise(other))


def _ssn(key: str, x: Column) -> tuple[Column, Column]:
    d = _digits(x)
    area, group, serial = _part(d, 1, 3), _part(d, 4, 2), _part(d, 6, 4)
    left = area - F.when(area > 666, 2).otherwise(1)  # 1..665 and 667..899
    s = feistel(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    new = F.transform(
        F.array(s),
        lambda s: F.concat(
            _pad(s["l"] + F.when(s["l"] > 664, 2).otherwise(1), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4)
        ),
    )[0]
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), _refill(x, new)


def _ip(key: str, x: Column) -> tuple[Column, Column]:
    o = [F.get(F.split(x, r"\."), i).try_cast("long") for i in range(4)]
    s = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    new = F.transform(
        F.array(s),
        lambda s: F.concat_ws(".", *[v.cast("string") for v in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]),
    )[0]
    return reduce(lambda a, b: a & b, [v <= 255 for v in o]), new


#: Days of the months of a common year behind the 28th, in order.
_LATE = [(m, d) for m, days in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(29, days + 1)]
_LEAP = [y for y in range(1800, 2200, 4) if y % 100 or not y % 400]


def _late_days(day: Column) -> Column:
    """The place of a date after the 12th among all such dates of the 400 years:
    those up to the 28th month by month, then the rest year by year, then the
    29ths of February."""
    year, month, d = F.year(day) - 1800, F.month(day), F.dayofmonth(day)
    late = F.array_position(F.array(*[F.lit(100 * m + k) for m, k in _LATE]), (100 * month + d).cast("int")) - 1
    leap = F.array_position(F.array(*map(F.lit, _LEAP)), (year + 1800).cast("int")) - 1
    rest = F.when((month == 2) & (d == 29), 88_400 + leap).otherwise(76_800 + year * 29 + late)
    return F.when(d <= 28, (year * 12 + month - 1) * 16 + d - 13).otherwise(rest).cast("long")


def _late_date(n: Column) -> Column:
    """The date at a place that ``_late_days`` gives."""
    months = F.floor(n / 16)
    plain = F.make_date((1800 + F.floor(months / 12)).cast("int"), (months % 12 + 1).cast("int"), (n % 16 + 13).cast("int"))
    k = F.get(F.array(*[F.lit(100 * m + d) for m, d in _LATE]), ((n - 76_800) % 29).cast("int"))
    rest = F.make_date((1800 + F.floor((n - 76_800) / 29)).cast("int"), F.floor(k / 100).cast("int"), (k % 100).cast("int"))
    leap = F.make_date(F.get(F.array(*map(F.lit, _LEAP)), (n - 88_400).cast("int")), F.lit(2), F.lit(29))
    return F.when(n < 76_800, plain).when(n < 88_400, rest).otherwise(leap)


def _date(key: str, x: Column) -> tuple[Column, Column]:
    """yyyy-mm-dd, dd.mm.yyyy, and with slashes mm/dd/yyyy, or dd/mm/yyyy where
    the first number is no month."""
    iso = x.rlike("^[0-9]{4}-")
    month_first = (F.substring(x, 3, 1) == "/") & (_part(x, 1, 2) <= 12)
    turned = F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))
    us = F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 1, 2), F.substring(x, 4, 2))
    day = F.when(iso, x).when(month_first, us).otherwise(turned).try_cast("date")
    early = F.dayofmonth(day) <= 12
    n = ((F.year(day) - 1800) * 12 + F.month(day) - 1) * 12 + F.dayofmonth(day) - 1
    first = feistel(key, "early", F.floor(n / 240), n % 240, F.lit(240), F.lit(240))
    late = _late_days(day)
    later = feistel(key, "late", F.floor(late / 9833), late % 9833, F.lit(9), F.lit(9833))

    def early_date(s: Column) -> Column:
        k = s["l"] * 240 + s["r"]
        months = F.floor(k / 12)
        return F.make_date((1800 + F.floor(months / 12)).cast("int"), (months % 12 + 1).cast("int"), (k % 12 + 1).cast("int"))

    new = F.when(early, F.transform(F.array(first), early_date)[0]).otherwise(
        F.transform(F.array(later), lambda s: _late_date(s["l"] * 9833 + s["r"]))[0]
    )
    shown = F.transform(
        F.array(new),
        lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(month_first, F.date_format(d, "MM/dd/yyyy"))
        .when(F.substring(x, 3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")),
    )[0]
    return day.isNotNull() & F.year(day).between(1800, 2199), shown


def _iban(key: str, x: Column) -> tuple[Column, Column]:
    flat = F.replace(x, F.lit(" "), F.lit(""))
    n = F.length(flat)
    lengths = F.create_map(*[F.lit(v) for k, names in IBAN_LENGTHS.items() for c in names.split() for v in (c, k)])
    country, bban = F.substring(flat, F.lit(1), F.lit(2)), F.substring(flat, F.lit(5), n - 4)
    digits = _half_digits(key, "iban", _digits(bban))
    new = F.transform(F.array(_refill(bban, digits)), lambda b: F.concat(_pad(98 - _mod97(country, F.lit("00"), b), 2), _digits(b)))[0]
    valid = n.between(15, 34) & (n == F.coalesce(F.try_element_at(lengths, country), n)) & (_mod97(country, F.substring(flat, F.lit(3), F.lit(2)), bban) == 1) & (F.length(_digits(bban)) >= 2)
    return valid, _refill(x, new)


def _email(key: str, x: Column) -> tuple[Column, Column]:
    local, domain = F.substring_index(F.lower(x), "@", 1), F.substring_index(x, "@", -1)
    word = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local, F.lower(domain)), 256)
    return F.lit(True), F.concat(F.lit("user"), F.substring(word, F.lit(1), F.lit(24)), F.lit("@"), domain)


def _kind(x: Column) -> Column:
    """The kind of a find: the first whose pattern is all of it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(x.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _usual(kind: Column, x: Column) -> Column:
    """Whether a value has the length that values of its beginning mostly have."""
    d = _digits(x)
    card = F.when(d.rlike("^3[47]"), 15).when(d.rlike("^3[068]"), 14).otherwise(16)
    phone = F.lit(None).cast("int")
    for code, n in PHONE_LENGTHS.items():
        phone = F.when(d.startswith(code), F.lit(n)).otherwise(phone)
    return F.coalesce(F.when(kind == "card", F.length(d) == card).when(kind == "phone", x.startswith("+") & (F.length(d) == phone)), F.lit(False))


def _ends(kind: Column, x: Column) -> Column:
    """A find and, of cards, phones and IBANs, what is left of it without its
    last groups, in the order in which they are tried."""
    groups = F.regexp_extract_all(x, F.lit("[ .-]*[^ .-]+"), F.lit(0))
    cut = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), ""))
    least = F.when(kind == "phone", 8).otherwise(13)  # shorter ends are valid for none
    cut = F.filter(cut, lambda c: F.length(c) >= least)
    first = F.filter(cut, lambda c: _usual(kind, c))
    return F.when(kind.isin("card", "phone", "iban") & (F.size(groups) > 1), F.array_distinct(F.concat(first, cut))).otherwise(F.array(x))


def pseudonym(find: Column, key: str) -> Column:
    """struct(kind, old, new): ``old`` is the valid value that the find starts
    with; kind is null where there is none, and old and new are then the find."""
    makers = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone}

    def typed(of: Column, x: Column) -> Column:
        kind, new = F.lit(None).cast("string"), x
        for name, make in makers.items():
            valid, value = make(key, x)
            hit = (of == name) & F.coalesce(valid, F.lit(False))
            kind = F.when(hit, F.lit(name)).otherwise(kind)
            new = F.when(hit, value).otherwise(new)
        return F.struct(kind.alias("kind"), x.alias("old"), new.alias("new"))

    def first_valid(s: Column) -> Column:
        none = F.struct(F.lit(None).cast("string").alias("kind"), s["x"].alias("old"), s["x"].alias("new"))
        return F.aggregate(_ends(s["kind"], s["x"]), none, lambda found, x: F.when(found["kind"].isNotNull(), found).otherwise(typed(s["kind"], x)))

    return F.transform(F.array(F.struct(_kind(find).alias("kind"), find.alias("x"))), first_valid)[0]


def _taken(pieces: Column, made: Column) -> Column:
    """array of (kind, old, new, after): ``pieces`` of a text, each from one
    start of a find to the next, less what valid finds have taken."""
    empty = F.array().cast("array<struct<kind:string,old:string,new:string,after:string>>")

    def step(acc: Column, s: Column) -> Column:
        piece, m, skip = s["piece"], s["m"], acc["skip"]
        hit = (skip == 0) & m["kind"].isNotNull()
        gone = F.when(hit, F.length(m["old"])).otherwise(skip)
        one = F.struct(
            F.when(hit, m["kind"]).alias("kind"), F.when(hit, m["old"]).alias("old"), F.when(hit, m["new"]).alias("new"),
            F.substring(piece, gone + 1, F.length(piece)).alias("after"),
        )
        return F.struct(F.greatest(gone - F.length(piece), F.lit(0)).alias("skip"), F.array_append(acc["done"], one).alias("done"))

    # in runs, since an array that grows is copied with each step
    pairs = F.zip_with(pieces, made, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))

    def run(acc: Column, lo: Column) -> Column:
        start = F.struct(acc["skip"].alias("skip"), empty.alias("done"))
        return F.aggregate(
            F.slice(pairs, lo, F.lit(RUN)), start, step,
            lambda end: F.struct(end["skip"].alias("skip"), F.array_append(acc["done"], end["done"]).alias("done")),
        )

    runs = F.sequence(F.lit(1), F.greatest(F.size(made), F.lit(1)), F.lit(RUN))
    nothing = F.struct(F.lit(0).alias("skip"), F.array(empty).alias("done"))  # an empty run to start with
    return F.aggregate(runs, nothing, run, lambda end: F.flatten(end["done"]))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, plus finds (array of
    kind, old, new), n_pii and a count n_<kind> of each kind."""
    src = F.col(text)
    old, new, pieces, done = fresh(docs.columns, "old", "new", "pieces", "done")
    # all places where a find starts, those inside of other finds too
    marked = docs.withColumn(old, F.regexp_extract_all(src, F.lit(f"(?=({FINDER}))"), F.lit(1)))
    some = F.size(old) > 0
    marked = marked.withColumn(new, F.when(some, F.transform(old, lambda x: pseudonym(x, key))))
    marked = marked.withColumn(pieces, F.when(some, F.split(src, f"(?={FINDER})", -1)))
    ahead = F.size(pieces) - F.size(old)  # 0 where the text starts with a find, else 1
    marked = marked.withColumn(done, F.when(some, _taken(F.slice(pieces, ahead + 1, F.size(old)), F.col(new))))
    head = F.when(ahead > 0, F.get(pieces, F.lit(0))).otherwise("")
    joined = F.concat(head, F.array_join(F.transform(done, lambda d: F.concat(F.coalesce(d["new"], F.lit("")), d["after"])), ""))
    finds = F.transform(F.filter(done, lambda d: d["kind"].isNotNull()), lambda d: F.struct(d["kind"].alias("kind"), d["old"].alias("old"), d["new"].alias("new")))
    out = marked.withColumn("finds", F.coalesce(finds, F.expr("cast(array() as array<struct<kind:string,old:string,new:string>>)")))
    out = out.withColumn(text, F.when(F.size("finds") > 0, joined).otherwise(src)).drop(old, new, pieces, done)
    kinds = F.transform("finds", lambda s: s["kind"])
    counts = {f"n_{k}": F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in KINDS}
    return out.withColumns({"n_pii": F.size("finds"), **counts})
