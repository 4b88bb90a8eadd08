"""The registered queries of the library outside the training-data subpackage, and their DuckDB SQL."""

from __future__ import annotations

from attestry.jobs import catalog, governance, ledger, spend, streams, texts  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
