"""Scalar rules as Spark columns; everything else is built from these."""

from colonnade.functions.instants import instant_from_text, nanosecond_tail
from colonnade.functions.numbers import finite_or_null, number_from_text
from colonnade.functions.rounding import percentage, round_binary
from colonnade.functions.text import is_blank, natural_key, stripped

__all__ = [
    "finite_or_null",
    "instant_from_text",
    "is_blank",
    "nanosecond_tail",
    "natural_key",
    "number_from_text",
    "percentage",
    "round_binary",
    "stripped",
]
