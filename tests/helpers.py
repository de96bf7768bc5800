from __future__ import annotations

import datetime as dt
import random

T0 = dt.datetime(2024, 1, 1)


def hours(spark, values: dict[str, list], start: dt.datetime = T0):
    """An hourly panel from lists of values per series."""
    rows = [
        (start + dt.timedelta(hours=i), series, None if v is None else float(v))
        for series, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(rows, "datetime timestamp, country string, quantity_MW double")


def at(spark, rows: list[tuple], schema: str = "datetime string, country string, quantity_MW double, key int"):
    return spark.createDataFrame(rows, schema).selectExpr(
        "cast(datetime as timestamp) as datetime", *[c.split()[0] for c in schema.split(", ")[1:]]
    )


def noise_series(n: int, seed: int = 1) -> list[float]:
    rng = random.Random(seed)
    return [round(rng.gauss(100, 20), 3) for _ in range(n)]


def as_set(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}
