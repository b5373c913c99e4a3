"""Arrow functions whose memory follows a slice of a batch, and which the planner does not evaluate twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

SLICE = 2 << 20  # bytes of Arrow data that are made Python values together


def slices(columns: tuple[pa.Array, ...], size: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of columns in order, halved until they have at most `size` bytes; a row that is larger stands alone."""
    n, size = len(columns[0]), SLICE if size is None else size
    if n < 2 or sum(c.nbytes for c in columns) <= size:
        yield columns
    else:
        for at, k in ((0, n // 2), (n // 2, n - n // 2)):
            yield from slices(tuple(c.slice(at, k) for c in columns), size)


def stepwise(returns, stream: bool = True) -> Callable:
    """An Arrow UDF of a function from arrays to an array of as many rows, which is called for one slice of a batch after the other.

    With stream each slice's results leave the worker before the next one; to the planner such a UDF is not deterministic:
    else a filter on what it gives, or an explode, is pushed below it with a second evaluation in one more worker. Without,
    the results of a batch are kept together (for small ones), and several UDFs of one projection share a worker.
    """

    def made(f: Callable[..., pa.Array]) -> Callable:
        def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for b in batches:
                for part in slices((b,) if isinstance(b, pa.Array) else tuple(b)):
                    yield f(*part)

        def whole(*columns: pa.Array) -> pa.Array:
            return pa.concat_arrays([f(*part) for part in slices(columns)])

        return F.arrow_udf(each, returns).asNondeterministic() if stream else F.arrow_udf(whole, returns)

    return made
