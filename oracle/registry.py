"""All DuckDB statements by query name."""

from __future__ import annotations

from demandspark.plans.catalog import NULLABLE


def statements() -> dict[str, str]:
    from oracle import sql_demand, sql_load, sql_measures, sql_quality, sql_stock, sql_weekly

    def shown(name: str, sql: str) -> str:
        columns = NULLABLE.get(name)
        if not columns:
            return sql
        casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
        return f"SELECT * REPLACE ({casts}) FROM ({sql})"

    parts = (sql_load, sql_quality, sql_weekly, sql_demand, sql_stock, sql_measures)
    return {name: shown(name, sql) for part in parts for name, sql in part.ORACLE.items()}
