"""Import every query module so that the catalog is complete."""

from __future__ import annotations

import importlib

from flowlens.plans.catalog import CATALOG, Entry

MODULES = ["q_analytics", "q_flows", "q_detect", "q_compliance", "q_sessions", "q_io", "q_stream", "q_windows", "q_store"]


def catalog() -> dict[str, Entry]:
    for m in MODULES:
        importlib.import_module(f"flowlens.plans.{m}")
    return CATALOG
