"""Names of working columns that clash with no column of the caller."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` with so many underscores before them that none is taken (column
    names differ by more than case)."""
    known = {t.lower() for t in taken}
    mark = "_"
    while any((mark + n).lower() in known for n in names):
        mark += "_"
    return [mark + n for n in names]
