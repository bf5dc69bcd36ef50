"""Compare a registered query with its SQL, row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    data = table.select(names).to_pydict()
    rows = [tuple(map(_plain, row)) for row in zip(*[data[n] for n in names], strict=True)]
    return names, sorted(rows, key=repr)


def differences(spark_table, oracle_table) -> str | None:
    """None when equal, otherwise what differs first."""
    names, rows = _rows(spark_table)
    other_names, other_rows = _rows(oracle_table)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows != {len(other_rows)}"
    for row, other in zip(rows, other_rows, strict=True):
        if row != other:
            return f"{names}: {row} != {other}"
    types = [str(spark_table.schema.field(n).type).replace("large_", "") for n in names]
    other_types = [str(oracle_table.schema.field(n).type).replace("large_", "") for n in names]
    if types != other_types:
        return f"types {dict(zip(names, types, strict=True))} != {dict(zip(names, other_types, strict=True))}"
    return None
