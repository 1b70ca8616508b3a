"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def registries() -> list:
    """The registries of this subpackage, one per module of queries."""
    from millrace.llm import queries

    return [queries.R]
