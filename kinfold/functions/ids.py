"""Identity digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def entity_id(name: Column, emails: Column, phones: Column) -> Column:
    """SHA-256 of name, sorted e-mails and sorted phones; missing parts are empty."""
    empty = F.array().cast("array<string>")
    mails = F.array_sort(F.transform(F.coalesce(emails, empty), lambda e: F.lower(strip(e))))
    calls = F.array_sort(F.coalesce(phones, empty))
    parts = [F.coalesce(F.lower(strip(name)), F.lit("")), F.array_join(mails, "|"), F.array_join(calls, "|")]
    return F.sha2(F.concat_ws("||", *parts), 256)
