"""Registered queries and their SQL."""

import importlib

from .registry import Registry, core

MODULES = ("integrity", "reports", "graphs", "records", "texts", "analysis", "streams", "store", "insight")


def load() -> Registry:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return core
