"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from quarry.plans.registry import REGISTRY

MODULES = ["regression", "explore", "cleaning", "statistics", "timeseries", "models", "io", "charts"]


def load_all():
    for m in MODULES:
        importlib.import_module(f"quarry.plans.{m}")
    return REGISTRY
