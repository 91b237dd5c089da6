"""Registered queries (one module per operator family)."""

import importlib

MODULES = ("retrieval", "catalog", "publish", "lineage", "text", "streaming")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
