"""Registered queries, one module per area."""

from importlib import import_module

_MODULES = ("structures", "pocket", "mutation_sets", "recommendations", "evaluation", "profile_log", "learning")


def load() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
