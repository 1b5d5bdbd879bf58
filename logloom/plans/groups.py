"""Groups in sorted Arrow batches.

A grouped map call costs about a millisecond per group. Where groups are many and small, the rows are
sorted by group instead, and one call walks through all groups of a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_changes(batch: pa.RecordBatch, names: list[str], previous: pa.RecordBatch | None) -> np.ndarray:
    """Positions at which a row differs from the row before in one of the columns; NULL equals NULL."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        c = batch.column(name)
        a, z = c.slice(1), c.slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(a, z), False)
        one_null = pc.xor(pc.is_null(a), pc.is_null(z))
        change[1:] |= pc.or_(differ, one_null).to_numpy(zero_copy_only=False)
    change[0] = previous is not None and any(
        batch.column(n)[0].as_py() != previous.column(n)[0].as_py() for n in names
    )
    return np.flatnonzero(change)
