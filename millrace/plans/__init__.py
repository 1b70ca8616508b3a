"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("references", "cleaning", "retrieval", "state", "textops", "relational", "accounts", "replays")


def registries() -> list:
    """The registries of the core, one per module."""
    return [import_module(f"millrace.plans.{m}").R for m in MODULES]
