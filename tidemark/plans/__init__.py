"""Queries over the driver's tables, one module for each part of the library, with the SQL that says the same."""

from __future__ import annotations


def _registered():
    from . import registry, replication, rewrites, scans, writes  # noqa: F401

    return registry


def queries() -> dict:
    return dict(_registered().QUERIES)


def oracles() -> dict[str, str]:
    return dict(_registered().ORACLES)
