"""Python over texts in slices of an Arrow batch, so that a worker holds few of its texts as Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

SLICE_BYTES = 1 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in consecutive parts of `most` bytes, or of one text if that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def text_udf(work: Callable, kind: DataType):
    """A function of a text column that gives work(text or None), slice by slice."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts):
                yield pa.array([work(t) for t in part.to_pylist()], arrow)

    return F.arrow_udf(run, kind)
