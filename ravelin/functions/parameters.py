"""Parameters given as text."""

from __future__ import annotations


def windows(text: str) -> list[int]:
    """Distinct half-windows in rising order of `3,5,10`; negative ones are an error."""
    found = sorted({int(p) for p in text.split(",") if p.strip()})
    if not found or found[0] < 0:
        raise ValueError(f"not a list of window sizes: {text!r}")
    return found


def budgets(text: str) -> list[float]:
    """Distinct positive budgets of `5,10,0.2`, in the order given."""
    found = list(dict.fromkeys(float(p) for p in text.split(",") if p.strip()))
    if not found or min(found) <= 0:
        raise ValueError(f"not a list of budgets: {text!r}")
    return found


def one_of(name: str, value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{name} is {value!r}, not one of {', '.join(choices)}")
    return value


def within(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}, not from {low} to {high}")
    return value
