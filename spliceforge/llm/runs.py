"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    nulls = pc.xor(pc.is_null(a), pc.is_null(b))
    unequal = pc.not_equal(a, b)
    if pa.types.is_floating(a.type):
        unequal = pc.and_(unequal, pc.invert(pc.and_(pc.is_nan(a), pc.is_nan(b))))
    return np.asarray(pc.fill_null(unequal, False).to_numpy(zero_copy_only=False) | nulls.to_numpy(zero_copy_only=False))


class RunFinder:
    """Tells where runs of equal keys begin, batch after batch; nulls equal nulls, NaN equals NaN."""

    def __init__(self, keys: list[str]):
        self.keys, self.last = keys, None

    def starts(self, batch: pa.RecordBatch) -> np.ndarray:
        """Boolean per row: whether it begins a run; the first row of a batch may go on with the last one's run."""
        new = np.zeros(batch.num_rows, bool)
        columns = [batch.column(batch.schema.get_field_index(k)) for k in self.keys]
        if self.last is None:
            new[0] = True
        else:
            new[0] = any(_differs(c.slice(0, 1), x)[0] for c, x in zip(columns, self.last))
        for c in columns:
            new[1:] |= _differs(c.slice(1), c.slice(0, len(c) - 1))
        self.last = [pa.concat_arrays([c.slice(len(c) - 1, 1)]) for c in columns]
        return new
