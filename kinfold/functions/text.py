"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``(?U)\\s`` matches: trimming by a set of characters looks at the ends only.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use) -> Column:
    """``use`` of a value that is found once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.btrim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Stripped; blank and null give null."""
    return once(strip(c), lambda s: F.nullif(s, F.lit("")))


def distinct_by(items: Column, key) -> Column:
    """First item of each key, in order."""

    def first(items: Column) -> Column:
        return once(F.transform(items, key), lambda keys: F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    return once(items, first)


def title(c: Column) -> Column:
    """Each run of letters gets an upper-case first letter and a lower-case rest
    (``initcap`` only looks at spaces)."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def title_if_flat(c: Column) -> Column:
    """Title case if the text is all upper or all lower case, else the stripped text."""

    def titled(t: Column) -> Column:
        flat = (F.upper(t) != F.lower(t)) & ((F.upper(t) == t) | (F.lower(t) == t))
        return F.when(flat, title(t)).otherwise(t)

    return once(strip(c), titled)


def lines(text: Column) -> Column:
    """Stripped lines that are not empty: white space around line breaks goes in one
    pass, which looks at each run of it once."""
    return F.filter(F.split(F.regexp_replace(strip(text), r"(?U)(?<!\s)\s*\n\s*", "\n"), "\n"), lambda x: x != "")


def split_clean(c: Column, pattern: str) -> Column:
    """Stripped parts that are not empty."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
