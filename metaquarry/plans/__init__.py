"""Registered queries, by family."""

from importlib import import_module

FAMILIES = ["search", "catalogs", "statements", "tasks", "conversations", "streams", "models"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"metaquarry.plans.{family}")
