"""The query catalog: one entry per inventory id, with its SQL oracle."""

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = (
    "sources",
    "frames",
    "joins",
    "aggregates",
    "windows",
    "selection",
    "domain",
    "signals",
    "events",
    "machines",
    "portfolio",
    "performance",
    "strategies",
)


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
