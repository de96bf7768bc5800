"""Scoring rows with a model trained elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def score_external(
    df: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    x: str = "X",
    y: str | None = "Y",
) -> DataFrame:
    """Rows without ``x`` and ``y`` but with ``y_pred`` and, from ``y``, ``y_true``.

    ``predict`` gets a (rows, width) double matrix per Arrow batch and returns (rows, leads).
    It is sent to the executors once per task; rows stay where they are. Rows without ``x`` are not shown to
    it and have no ``y_pred``; a NULL inside ``x`` is NaN, and NaN in a forecast becomes NULL. All ``x`` of a
    batch must be of one length.
    """
    return score_inputs(df, lambda given: predict(given[x]), {x: None}, y, one_length=True)


def score_inputs(
    df: DataFrame,
    predict: Callable[[dict[str, np.ndarray]], np.ndarray],
    inputs: Mapping[str, int | None],
    y: str | None = "Y",
    quantiles: int = 0,
    one_length: bool = False,
) -> DataFrame:
    """Rows without the input columns and ``y`` but with ``y_pred`` and, from ``y``, ``y_true``, for models with several inputs.

    ``inputs`` names array columns and how they are shown: (rows, width) for None, (rows, steps, d) for a time-major array of
    vectors of length d; 0 stands for a number per row, shown as (rows,). ``predict`` gets all inputs of some rows of a
    batch together; rows whose arrays have other lengths are shown apart (``one_length`` makes them an error). It
    returns (rows, leads), or (rows, leads, ``quantiles``), then ``y_pred`` has an array of quantiles per
    lead. Rows without any one input are not shown and have no ``y_pred``; NULL inside an input is NaN, NaN in a forecast NULL.
    """
    hidden = {name: f"_in{i}" for i, name in enumerate(inputs)}
    keys = [c for c in df.columns if c not in inputs and c != y]
    truth = [F.col(y).cast("array<double>").alias("y_true")] if y else []
    kind = {name: "double" if d == 0 else "array<double>" for name, d in inputs.items()}
    rows = df.select(*keys, *truth, *[F.col(c).cast(kind[c]).alias(h) for c, h in hidden.items()])
    kept = [f for f in rows.schema.fields if f.name not in hidden.values()]
    forecast_type = T.ArrayType(DOUBLES) if quantiles else DOUBLES

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = {c: batch.column(batch.schema.get_field_index(h)) for c, h in hidden.items()}
            there = np.ones(n, dtype=bool)
            for column in given.values():
                there &= column.is_valid().to_numpy(zero_copy_only=False)
            place = np.flatnonzero(there)
            sizes = np.zeros((len(place), 0), dtype=np.int64)
            for c, d in inputs.items():
                if d != 0:
                    sizes = np.c_[sizes, given[c].value_lengths().to_numpy(zero_copy_only=False)[place]]
            kinds, which = np.unique(sizes, axis=0, return_inverse=True)
            if one_length and len(kinds) > 1:
                raise ValueError(f"{', '.join(inputs)} has rows of different lengths")
            parts, at = [], []
            for k in range(len(kinds) if len(place) else 0):
                mine = place[which.reshape(-1) == k]
                shown = {}
                for c, d in inputs.items():
                    picked = given[c].take(pa.array(mine))
                    if d == 0:
                        shown[c] = picked.to_numpy(zero_copy_only=False).astype(float)
                    else:
                        values = picked.flatten().to_numpy(zero_copy_only=False).astype(float)
                        shown[c] = values.reshape(len(mine), -1, d) if d else values.reshape(len(mine), -1)
                parts.append(np.asarray(predict(shown), dtype=float).reshape(len(mine), -1))
                at.append(mine)
            width = {p.shape[1] for p in parts}
            if len(width) > 1:
                raise ValueError("the model gives forecasts of different lengths")
            forecast = np.zeros((0, 0))
            if parts:
                order = np.argsort(np.concatenate(at), kind="stable")
                forecast = np.concatenate(parts)[order]
            leads = forecast.shape[1] // (quantiles or 1)
            flat = forecast.reshape(-1)
            numbers = pa.array(flat, mask=np.isnan(flat))
            if quantiles:
                numbers = pa.ListArray.from_arrays(pa.array((np.arange(len(flat) // quantiles + 1) * quantiles).astype(np.int32)), numbers)
            ends = np.concatenate([[0], np.cumsum(there)]) * leads
            offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.concatenate([~there, [False]]))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns.append(pa.ListArray.from_arrays(offsets, numbers))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["y_pred"])

    return rows.mapInArrow(score, T.StructType([*kept, T.StructField("y_pred", forecast_type)]))
