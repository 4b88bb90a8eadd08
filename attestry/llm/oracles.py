"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import hamming_search, mixing, vector_codes

ORACLES: dict[str, str] = {
    "op5_hamming_search": hamming_search.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
