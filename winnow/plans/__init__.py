"""All registered queries."""

import importlib

from winnow.plans.registry import ORACLES, QUERIES

for _family in ("screening", "texts", "code", "repos", "profiles"):
    importlib.import_module(f"winnow.plans.{_family}")

__all__ = ["ORACLES", "QUERIES"]
