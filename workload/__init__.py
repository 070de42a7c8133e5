"""Registered queries and their SQL counterparts, grouped by area."""

from importlib import import_module

AREAS = ("profile", "quality", "arrays", "features", "evaluation", "modelling", "ingest", "reporting")


def load_all() -> None:
    for area in AREAS:
        import_module(f"workload.{area}")
