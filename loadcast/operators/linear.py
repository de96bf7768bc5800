"""A multi-output linear forecaster fitted from distributed cross products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.operators.score import score_external
from loadcast.operators.windows import no_gaps


@dataclass(frozen=True)
class CrossProducts:
    """Moments of the rows ``Z = (X, Y)``: their number, means, least and greatest values, and the sums of products
    of the distances from the means. Their size depends on the widths only."""

    rows: int
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centred: np.ndarray
    x_dim: int

    @staticmethod
    def of(z: np.ndarray, x_dim: int) -> CrossProducts:
        mean = z.mean(axis=0)
        apart = z - mean
        return CrossProducts(len(z), mean, z.min(axis=0), z.max(axis=0), apart.T @ apart, x_dim)

    def merged(self, other: CrossProducts) -> CrossProducts:
        """The moments of both sets of rows; nothing is subtracted that is large against its result."""
        if (self.x_dim, len(self.mean)) != (other.x_dim, len(other.mean)):
            raise ValueError("rows of different widths")
        n = self.rows + other.rows
        gap = other.mean - self.mean
        return CrossProducts(
            n,
            self.mean + gap * (other.rows / n),
            np.minimum(self.low, other.low),
            np.maximum(self.high, other.high),
            self.centred + other.centred + np.outer(gap, gap) * (self.rows * other.rows / n),
            self.x_dim,
        )


@dataclass(frozen=True)
class LinearModel:
    """``Y = intercept + X @ weights``; ``dropped`` are the features that never varied and so have no weight."""

    intercept: np.ndarray
    weights: np.ndarray
    dropped: tuple[int, ...] = ()

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficients as ``(lead, feature, weight)``; feature 0 is the intercept."""
        full = np.vstack([self.intercept, self.weights])
        rows = [
            (int(k) + 1, int(i), float(full[i, k]))
            for k in range(full.shape[1])
            for i in range(full.shape[0])
        ]
        return spark.createDataFrame(rows, "lead int, feature int, weight double")

    @staticmethod
    def from_table(table: DataFrame) -> LinearModel:
        rows = table.collect()
        full = np.zeros((max(r["feature"] for r in rows) + 1, max(r["lead"] for r in rows)))
        for r in rows:
            full[r["feature"], r["lead"] - 1] = r["weight"]
        return LinearModel(full[0], full[1:])


# Tasks that the moments of all tasks are merged in before they reach the driver.
MERGE_TASKS = 16
MOMENTS = "x_dim int, n long, mean array<double>, low array<double>, high array<double>, centred array<double>"


def moment_table(df: DataFrame, x: str = "X", y: str = "Y", by: Sequence[str] = ()) -> DataFrame:
    """Moments of ``(X, Y)`` as rows ``(by…, x_dim, n, mean, low, high, centred)``, at most ``MERGE_TASKS`` per ``by``.

    Every task reduces its rows to one matrix per ``by`` value with BLAS; whole matrices are then merged in a
    few tasks. Rows with a NULL or NaN entry are left out.
    """
    schema, names = df.schema, list(by)
    columns = ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in by), MOMENTS])

    def reduced(batches, read):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for label, part in read(batch):
                known = sums.get(label)
                sums[label] = part if known is None else known.merged(part)
        for label, m in sums.items():
            arrays = [pa.array([v]) for v in label]
            arrays += [pa.array([m.x_dim], pa.int32()), pa.array([m.rows], pa.int64())]
            arrays += [pa.array([v.reshape(-1)], pa.list_(pa.float64())) for v in (m.mean, m.low, m.high, m.centred)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "x_dim", "n", "mean", "low", "high", "centred"])

    def from_rows(batch):
        import numpy as np
        import pyarrow.compute as pc

        if not batch.num_rows:
            return

        def matrix(column):
            return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

        left, right = matrix(batch.column("_x")), matrix(batch.column("_y"))
        z = np.hstack([left, right])
        if not names:
            yield (), CrossProducts.of(z, left.shape[1])
            return
        code = np.zeros(len(z), dtype=np.int64)
        for c in names:
            coded = pc.dictionary_encode(batch.column(c), null_encoding="encode")
            code = code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        for k, at in enumerate(first.tolist()):
            label = tuple(batch.column(c)[at].as_py() for c in names)
            yield label, CrossProducts.of(z[np.flatnonzero(inverse == k)], left.shape[1])

    def from_moments(batch):
        for r in batch.to_pylist():
            yield tuple(r[c] for c in names), _moments(r)

    doubles = df.select(*by, F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("array<double>").alias("_y"))
    doubles = doubles.where(no_gaps(F.col("_x")) & no_gaps(F.col("_y")))
    parts = doubles.mapInArrow(lambda batches: reduced(batches, from_rows), columns)
    return parts.repartition(MERGE_TASKS).mapInArrow(lambda batches: reduced(batches, from_moments), columns)


def _moments(row: dict) -> CrossProducts:
    mean, low, high, centred = (np.asarray(row[c], dtype=float) for c in ("mean", "low", "high", "centred"))
    return CrossProducts(int(row["n"]), mean, low, high, centred.reshape(len(mean), -1), int(row["x_dim"]))


def cross_products(df: DataFrame, x: str = "X", y: str = "Y", by: str | None = None) -> dict[str | None, CrossProducts]:
    """The merged moments on the driver, one per ``by`` value (a split name, for instance).

    Each has about (x_dim + y_dim)² entries, independent of the number of rows.
    """
    out: dict[str | None, CrossProducts] = {}
    for row in moment_table(df, x, y, [by] if by else []).toArrow().to_pylist():
        label, part = row[by] if by else None, _moments(row)
        out[label] = out[label].merged(part) if label in out else part
    if not out:
        raise ValueError("no complete rows to fit on")
    return out


def solve(products: CrossProducts, penalty: float = 0.0) -> LinearModel:
    """Least squares with a ridge ``penalty`` (per row) on the weights, not on the intercept.

    Only features that never vary get no weight; the model names them.
    """
    d = products.x_dim
    mean_x, mean_y = products.mean[:d], products.mean[d:]
    m = products.centred / products.rows
    xx, xy = m[:d, :d], m[:d, d:]
    used = (products.low[:d] < products.high[:d]) & (np.diag(xx) > 0)
    weights = np.zeros_like(xy)
    if used.any():
        s = np.sqrt(np.diag(xx)[used])
        left = xx[np.ix_(used, used)] / np.outer(s, s) + np.diag(penalty / s**2)
        weights[used] = np.linalg.lstsq(left, xy[used] / s[:, None], rcond=1e-12)[0] / s[:, None]
    return LinearModel(mean_y - mean_x @ weights, weights, tuple(np.flatnonzero(~used).tolist()))


def linear_fit(df: DataFrame, penalty: float = 0.0, x: str = "X", y: str = "Y") -> LinearModel:
    """The linear map from ``X`` to ``Y`` with the least squared error over all rows."""
    return solve(cross_products(df, x, y)[None], penalty)


def squared_error(model: LinearModel, products: CrossProducts) -> float:
    """Mean squared error of a model over the rows behind the moments."""
    d = products.x_dim
    m = products.centred / products.rows
    w = model.weights
    offset = products.mean[d:] - products.mean[:d] @ w - model.intercept
    spread = np.diag(m)[d:] - 2 * np.sum(w * m[:d, d:], axis=0) + np.sum(w * (m[:d, :d] @ w), axis=0)
    return float(np.mean(spread + offset**2))


def ridge_grid(
    df: DataFrame, penalties: Sequence[float], split: str = "split", x: str = "X", y: str = "Y"
) -> tuple[LinearModel, float, DataFrame]:
    """Choose the penalty with the least validation error.

    Training and validation rows are read once: all penalties are solved and judged from the
    two cross products. Returns the model, its penalty, and the table of both errors.
    """
    parts = cross_products(df.where(F.col(split).isin("train", "val")), x, y, split)
    tried = [(float(p), solve(parts["train"], p)) for p in penalties]
    rows = [(p, squared_error(m, parts["train"]), squared_error(m, parts["val"])) for p, m in tried]
    best = min(range(len(rows)), key=lambda i: (rows[i][2], rows[i][0]))
    table = df.sparkSession.createDataFrame(rows, "penalty double, train_mse double, val_mse double")
    return tried[best][1], tried[best][0], table


def linear_predict(df: DataFrame, model: LinearModel, x: str = "X", y: str | None = "Y") -> DataFrame:
    """Adds ``y_pred`` (and ``y_true`` from ``y``): one matrix product per Arrow batch."""
    weights, intercept = model.weights, model.intercept
    return score_external(df, lambda values: values @ weights + intercept, x, y)
