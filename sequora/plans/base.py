"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: DuckDB macros are not kept between statements; these pieces of SQL are pasted in instead.
NIBBLES = {d: "ACGT"[int(d, 16) >> 2] + "ACGT"[int(d, 16) & 3] for d in "0123456789abcdef"}
YIN_YANG = {d: "ACGT"[int(d, 16) >> 2] + "CGTA"[int(d, 16) & 3] for d in "0123456789abcdef"}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def dna_sql(column: str, codes: dict[str, str] = NIBBLES) -> str:
    out = f"lower(hex(encode({column})))"
    for digit, pair in codes.items():
        out = f"replace({out}, '{digit}', '{pair}')"
    return out


def gc_sql(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE (length({s}) - length(translate({s}, 'GC', ''))) / length({s}) END)"


def hp_sql(s: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, 'A+|C+|G+|T+'), lambda r: length(r))), 0)"
