"""Registered queries, one module per group of operators."""

from importlib import import_module

GROUPS = ("sources", "rows", "joins", "aggregates", "windows", "sets", "scalars", "panels",
          "regimes", "forecasts", "models", "calibration", "pooled", "streams", "evaluation",
          "inference", "extensions", "wide")


def load() -> None:
    from pkgutil import iter_modules
    present = {m.name for m in iter_modules(__path__)}
    for group in GROUPS:
        if group in present:
            import_module(f"{__name__}.{group}")
