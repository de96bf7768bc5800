"""Compare a Spark result with DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(t: pa.DataType) -> str:
    text = str(t).replace("large_", "")
    return "timestamp" if text.startswith("timestamp") else text


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda row: tuple((v is None, str(v)) for v in row))


def _cell(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """None if both agree, else what differs."""
    left = {f.name: kind(f.type) for f in spark_table.schema}
    right = {f.name: kind(f.type) for f in duck_table.schema}
    if left != right:
        return f"schema: {dict(set(left.items()) ^ set(right.items()))}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows: {spark_table.num_rows} and {duck_table.num_rows}"
    bad = 0
    example = None
    for a, b in zip(rows_of(spark_table), rows_of(duck_table)):
        if not all(_close(x, y) for x, y in zip(a, b)):
            bad += 1
            example = example or (a, b)
    return f"values: {bad} rows, such as {example}" if bad else None


def _close(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 2e-5 * max(1.0, abs(x))
    return x == y
