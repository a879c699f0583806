"""Numbers as compressed bytes, for what is shuffled or written."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value


def tightened(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes first."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), "zstd", asbytes=True) if len(values) else b""


def loosened(packed: bytes, kind: type, n: int) -> np.ndarray:
    """The numbers of `tightened`."""
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(packed, n * size, "zstd") if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
