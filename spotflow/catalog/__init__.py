"""Named queries over the test tables, each with the SQL that must agree with it."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("events", "anomalies", "places", "roads", "tracking", "feeds", "streams")


def load() -> None:
    for name in SECTIONS:
        import_module(f"spotflow.catalog.{name}")
