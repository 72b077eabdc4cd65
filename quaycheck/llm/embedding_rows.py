"""Rows of vectors in Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vectors(col: pa.Array) -> np.ndarray:
    """A list column without nulls whose lists have one length, as a matrix of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
