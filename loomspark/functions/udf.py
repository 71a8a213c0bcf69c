"""Pandas UDFs that are made when first used, as no session may exist when a module is imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        return call

    return wrap
