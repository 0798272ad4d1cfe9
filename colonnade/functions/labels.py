"""Number texts for titles and notes; used on bounded results only."""

from __future__ import annotations


def short(value: float) -> str:
    return f"{value:.6g}"


def significant(value: float, digits: int = 6) -> str:
    """Thousands separators and at most ``digits`` significant digits."""
    if value == 0:
        return "0"
    rounded = float(f"{value:.{digits - 1}e}")
    whole = len(str(int(abs(rounded)))) if abs(rounded) >= 1 else 0
    decimals = max(0, digits - whole) if whole else 20
    text = f"{rounded:,.{decimals}f}"
    if not whole:
        exponent = int(f"{abs(rounded):e}".split("e")[1])
        text = f"{rounded:,.{digits - 1 - exponent}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text
