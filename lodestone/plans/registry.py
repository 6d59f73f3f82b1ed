"""All queries over the driver's tables, by name, and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from lodestone.plans import kb, kb_sql, live

QUERIES: dict = {**kb.QUERIES, **live.QUERIES}
ORACLES: dict[str, str] = {**kb_sql.ORACLES, **live.ORACLES}
