"""Arrow UDFs whose return type is parsed when first used, as that needs a session.

Spark hands over batches of up to 10,000 rows whatever their size. A function sees slices of at most ``ROWS`` rows and
about ``LETTERS`` letters, and each slice's result goes back at once, so a worker never holds the results of a batch.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

ROWS, LETTERS = 256, 1 << 20


def slices(columns: tuple[pd.Series, ...]) -> Iterator[slice]:
    """Ranges of rows, each within both bounds; a row beyond them is a slice of its own."""
    sizes = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        if column.dtype == object:
            sizes += np.fromiter((len(x) if hasattr(x, "__len__") else 0 for x in column), np.int64, len(column))
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and (k - start == ROWS or held + size > LETTERS):
            yield slice(start, k)
            start, held = k, 0
        held += size
    yield slice(start, len(sizes))


def arrow_udf(kind: str):
    def wrap(f):
        made = []
        single = len(inspect.signature(f).parameters) == 1

        def run(batches):
            for batch in batches:
                columns = (batch,) if single else batch
                for part in slices(columns):
                    yield f(*[x.iloc[part].reset_index(drop=True) for x in columns])

        series = pd.Series if single else tuple[pd.Series, ...]
        made_of = pd.DataFrame if inspect.signature(f).return_annotation in ("pd.DataFrame", pd.DataFrame) else pd.Series
        run.__annotations__ = {"batches": Iterator[series], "return": Iterator[made_of]}

        def call(*columns):
            if not made:
                made.append(pandas_udf(run, kind))
            return made[0](*columns)

        call.__name__, call.__doc__, call.function = f.__name__, f.__doc__, f
        return call

    return wrap


def exploded(rows: DataFrame, keep: list[str], made: Column, item: str, place: str = "__place") -> DataFrame:
    """The kept columns, ``place`` and ``item``: a row an item of the array that a UDF makes, none for null or empty ones.

    From a plain explode Spark infers a filter on the array's size and runs the UDF for it once more, in a second worker.
    """
    return rows.select(*keep, F.posexplode_outer(made).alias(place, item)).where(F.col(place).isNotNull())
