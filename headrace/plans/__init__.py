"""Queries by topic over the driver's tables."""

from __future__ import annotations

import importlib

TOPICS = ("impact", "dispatch", "carbon", "tables", "places", "rollups", "files")


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"headrace.plans.{topic}")
