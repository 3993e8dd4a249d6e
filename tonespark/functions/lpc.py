"""Linear prediction of many blocks at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Prediction coefficients of ``order`` and the error left, by rows of autocorrelations from lag 0."""
    a, error = np.zeros((len(r), order)), r[:, 0].copy()
    for m in range(order):
        k = np.divide(r[:, m + 1] - (a[:, :m] * r[:, m:0:-1]).sum(axis=1), error, out=np.zeros(len(r)), where=error > 0)
        a[:, :m] -= k[:, None] * a[:, :m][:, ::-1]
        a[:, m] = k
        error *= 1 - k * k
    return a, error


def quantise(a: np.ndarray, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients as integers of ``precision`` bits and the shift that scales them; each coefficient's error is carried
    to the next."""
    top = np.abs(a).max(axis=1, initial=0)
    bits = np.floor(np.log2(np.where(top > 0, top, 1))) + 1
    shift = np.clip(precision - 1 - bits, 0, 15).astype(np.int64)
    most, carry, out = (1 << (precision - 1)) - 1, np.zeros(len(a)), np.zeros(a.shape, np.int64)
    for j in range(a.shape[1]):
        carry += a[:, j] * 2.0**shift
        out[:, j] = np.clip(np.sign(carry) * np.floor(np.abs(carry) + 0.5), -most - 1, most)
        carry -= out[:, j]
    return out, shift


def with_predictor(blocks: DataFrame, order: int, precision: int, r: str = "r") -> DataFrame:
    """``blocks`` with ``coefficients`` and ``shift`` from its arrays of autocorrelations ``r``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lags = np.array(batch.column(batch.schema.get_field_index(r)).to_pylist(), float)
                q, shift = quantise(levinson(lags, order)[0], precision)
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * order, pa.int32()), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, own, pa.array(shift)], [*batch.schema.names, "coefficients", "shift"])

    return blocks.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", coefficients array<bigint>, shift bigint")
