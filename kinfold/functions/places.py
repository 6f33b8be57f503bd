"""Countries, regions and cities as Column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinfold.constants import COUNTRY_ALIASES

from .skills import alias_map
from .text import clean, strip, title_if_flat


@lru_cache(maxsize=1)
def iso_names() -> dict[str, str]:
    """Lower-case alpha-2 codes, alpha-3 codes and English names of ISO 3166
    countries to alpha-2 codes, as the JVM knows them."""
    locale = SparkSession.active().sparkContext._jvm.java.util.Locale
    found: dict[str, str] = {}
    for code in locale.getISOCountries():
        here = locale("", code)
        for name in (here.getDisplayCountry(locale.ENGLISH), here.getISO3Country(), code):
            found[name.lower()] = code
    return found


def normalize_country(c: Column) -> Column:
    """Alpha-2 code by alias, code or name; else null."""
    s = F.lower(clean(c))
    return F.coalesce(F.try_element_at(alias_map(COUNTRY_ALIASES), s), F.try_element_at(alias_map(iso_names()), s))


def normalize_city(c: Column) -> Column:
    return title_if_flat(c)


def normalize_region(c: Column) -> Column:
    return strip(c)
