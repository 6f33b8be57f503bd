"""E-mail and phone normalisation as Column expressions.

Phones are numbers of a plan (see ``number_plan``): calling codes in use with the
lengths of their countries, and the area and exchange codes that North America has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .number_plan import Plan, assigned
from .text import once, strip

_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
ADDRESS = rf"^(?=.{{1,254}}$)(?=[^@]{{1,64}}@){_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+[a-z][a-z0-9-]*[a-z0-9]$"

def normalize_email(c: Column) -> Column:
    """Stripped and lower-cased; null if it is no address."""
    return once(F.lower(strip(c)), lambda e: F.when(e.rlike(ADDRESS), e))


def normalize_emails(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, normalize_email), lambda x: x.isNotNull()))


def normalize_phone(c: Column, plan: Plan | None = None) -> Column:
    """E.164, numbers without a country code being North American; else null."""

    def number(raw: Column) -> Column:
        plausible = raw.rlike(r"^[+(\d][\d\s().\-/]*$") & raw.rlike(r"\d")
        local = lambda d: F.when(d.rlike(r"^1?\d{10}$"), F.concat(F.lit("1"), F.right(d, F.lit(10))))
        whole = once(F.regexp_replace(raw, r"[^0-9]", ""), lambda d: F.when(raw.startswith("+"), d).otherwise(local(d)))
        return F.when(plausible, once(whole, lambda w: F.when(assigned(w, plan), F.concat(F.lit("+"), w))))

    return once(F.regexp_replace(strip(c), r"(?i)\s*(?:ext\.?|x|#)\s*\d{1,7}$", ""), number)


def normalize_phones(items: Column, plan: Plan | None = None) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda x: normalize_phone(x, plan)), lambda x: x.isNotNull()))
