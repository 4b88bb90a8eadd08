"""Where jobs register their query and, where SQL can express it, the DuckDB text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from attestry.sources import dims, receipts

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function (spark, sf_dir). tables: the derived tables and dimensions that its SQL reads."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [dims.cte(t) if t in dims.TABLES else receipts.cte(t) for t in tables]
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
            elif body.upper().startswith("WITH "):
                parts.append(body[5:])
                ORACLES[name] = "WITH " + ", ".join(parts)
            else:
                ORACLES[name] = ("WITH " + ", ".join(parts) + " " if parts else "") + body
        return f

    return register
