"""Helpers to write the DuckDB statements."""

from __future__ import annotations

import re
from collections.abc import Mapping


def money(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS DOUBLE)"


def chain(parts: Mapping[str, str], name: str, amounts: str = "", dates: str = "") -> str:
    """``name`` and the relations before it; only those it needs are kept.

    ``amounts`` and ``dates`` list columns shown as DOUBLE and as text, the
    plain form in which the Spark side shows decimals and dates too.
    """
    needed = {name}
    for part in reversed(list(parts)):
        if part in needed:
            needed |= {n for n in parts if n != part and re.search(rf"\b{n}\b", parts[part])}
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in parts.items() if n in needed)
    shown = [f"{money(c)} AS {c}" for c in amounts.split()]
    shown += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(shown)})" if shown else ""
    return f"WITH {ctes}\nSELECT *{replace} FROM {name}"
