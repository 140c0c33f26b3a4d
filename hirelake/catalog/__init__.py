"""Registered queries, one module per block of operators."""

import importlib
import pkgutil

from .registry import all_oracles, all_queries  # noqa: F401

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")
