"""What a column name suggests about its values. Names number at most 200."""

from __future__ import annotations

import re

# The words that carry a hint.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
BOOLEAN_DIGITS = ("0", "1")
BOOLEAN_NAMES = (
    "is has can was flag active enabled verified subscribed opted"
).split()
IDENTIFIER_NAMES = "id identifier zip postcode code".split()
ADDITIVE_NAMES = "revenue sales profit cost spend quantity units orders total".split()
NON_ADDITIVE_NAMES = (
    "rate ratio percent percentage average avg score age temperature"
).split()
KPI_NAMES = "revenue sales score temperature age".split()


def _has_word(name: str, words: list[str]) -> bool:
    """Whole word, where underscores, blanks and hyphens separate words."""
    return bool(set(re.split(r"[_\s-]", name.lower())) & set(words))


def suggests_boolean(name: str) -> bool:
    return _has_word(name, BOOLEAN_NAMES) or "bool" in name.lower()


def suggests_identifier(name: str) -> bool:
    return _has_word(name, IDENTIFIER_NAMES)


def suggests_additive(name: str) -> bool:
    return _has_word(name, ADDITIVE_NAMES)


def suggests_kpi(name: str) -> bool:
    return _has_word(name, KPI_NAMES)


def aggregation_hint(name: str) -> str:
    """``sum`` for measures that add up, ``mean`` for all others."""
    additive = suggests_additive(name) and not _has_word(name, NON_ADDITIVE_NAMES)
    return "sum" if additive else "mean"
