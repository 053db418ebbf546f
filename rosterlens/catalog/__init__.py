"""Registered queries over the generated tables."""

from importlib import import_module

MODULES = ["exposure", "checks", "sequences", "scoring", "search", "models", "refits", "links", "plans", "jobs"]


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
