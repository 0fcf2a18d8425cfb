"""Column expressions and kernels over one instrument's ordered bars."""

from __future__ import annotations


def available() -> list[str]:
    """Names of all indicators: window expressions, and kernels as they are added to frames."""
    from marketlab.functions import indicators, recurrences

    plain = {n for n, f in vars(indicators).items() if callable(f) and getattr(f, "__module__", "") == indicators.__name__ and not n.startswith("_")}
    kernels = {n.removeprefix("with_") for n in vars(recurrences) if n.startswith("with_")}
    return sorted(plain | kernels)
