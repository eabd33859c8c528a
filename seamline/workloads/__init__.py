"""Queries over the supplied tables, each with its SQL twin."""

from importlib import import_module

FAMILIES = [
    "sources",
    "sinks",
    "projections",
    "joins",
    "aggregations",
    "windows",
    "ordering",
    "scalars",
    "metrics",
    "weighting",
    "modelling",
    "texts",
    "streams",
]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"seamline.workloads.{family}")
