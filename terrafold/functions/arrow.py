"""Arrow functions that are wrapped when called, so that workers can import the modules that define them."""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str):
    """A column function from a function of pandas series."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap


def listed(returns: str, kind: pa.DataType):
    """The same for columns of nested arrays, which come as plain lists: as pandas, Spark takes only those whose inner arrays have one length."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            def work(*arrays: pa.Array) -> pa.Array:
                return pa.array(list(f(*(pd.Series(a.to_pylist(), dtype=object) for a in arrays))), kind, from_pandas=True)

            return F.arrow_udf(work, returns)(*columns)

        return call

    return wrap
