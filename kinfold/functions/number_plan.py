"""Number plans: which digits behind a plus sign may be a phone number.

A plan lists digit prefixes with the least and the most digits of whole numbers
that begin with them; the longest prefix of a number decides.  As a trie of digits a
plan becomes one pattern in which each node gives way to its children, so a column
of numbers is checked by one scan of each, without a join and inside the JVM.

The default plan has rules and lengths, not every area code in use; a deployment
that has a list of those passes it as further entries (``Plan.with_entries``,
``read_plan``).
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column

from kinfold.constants import CALLING_CODE, NATIONAL_LENGTHS, NORTH_AMERICAN

#: Digits of a number of a calling code whose lengths are not listed.
ANY = (8, 15)
NONE = (0, -1)


@dataclass(frozen=True)
class Plan:
    """``entries``: (prefix, least, most) with unique prefixes; a number whose
    longest prefix has least > most is not assigned."""

    entries: tuple[tuple[str, int, int], ...]

    def with_entries(self, more: list[tuple[str, int, int]]) -> Plan:
        """These entries over those of the same prefix."""
        for prefix, *_ in more:
            if not re.fullmatch("[0-9]{1,14}", prefix):
                raise ValueError(f"{prefix!r} is no prefix of digits")
        return Plan(tuple(sorted(({e[0]: e for e in self.entries} | {e[0]: tuple(e) for e in more}).values())))

    def pattern(self) -> str:
        """The plan as one pattern for whole numbers."""
        return _pattern(self)


@lru_cache(maxsize=8)
def _pattern(plan: Plan) -> str:
    trie: dict = {}
    for prefix, least, most in plan.entries:
        node = trie
        for digit in prefix:
            node = node.setdefault(digit, {})
        node["range"] = (least, most)

    def node_pattern(node: dict, depth: int, above: tuple[int, int]) -> str:
        least, most = node.get("range", above)
        children = {d: n for d, n in node.items() if d != "range"}
        options = [d + node_pattern(n, depth + 1, (least, most)) for d, n in sorted(children.items())]
        if most >= max(least, depth):
            front = f"(?![{''.join(sorted(children))}])" if children else ""
            options.append(f"{front}[0-9]{{{max(0, least - depth)},{most - depth}}}")
        return f"(?:{'|'.join(options)})" if options else "(?!)"

    return f"^{node_pattern(trie, 0, NONE)}$"


@lru_cache(maxsize=1)
def default_plan() -> Plan:
    """Calling codes in use with any length, those whose lengths are known, and
    what the North American plan keeps free."""
    codes = [str(c) for c in range(1, 1000) if re.fullmatch(CALLING_CODE, str(c))]
    known = {c: (len(c) + low, len(c) + high) for c, (low, high) in NATIONAL_LENGTHS.items()}
    entries = {c: known.get(c, ANY) for c in codes}
    entries["1"] = NONE
    for first in "23456789":  # area codes: N9X and the listed ones are free, N11 are services
        entries["1" + first] = (11, 11)
        for free in (f"{first}9", f"{first}11"):
            entries["1" + free] = NONE
    for free in NORTH_AMERICAN["free"]:
        entries["1" + free] = NONE
    return Plan(tuple(sorted((p, *r) for p, r in entries.items())))


def read_plan(path: str, base: Plan | None = None) -> Plan:
    """A plan with the entries of a CSV file (prefix, least, most) on the driver's side."""
    with open(path, newline="") as f:
        rows = [(r["prefix"], int(r["least"]), int(r["most"])) for r in csv.DictReader(f)]
    return (base or default_plan()).with_entries(rows)


def assigned(digits: Column, plan: Plan | None = None) -> Column:
    """Whether the digits behind a plus sign are a number of the plan.  In North
    America exchange codes begin with 2 to 9 and are no services (N11)."""
    north = ~digits.rlike(NORTH_AMERICAN["no_exchange"])
    return digits.rlike((plan or default_plan()).pattern()) & north
