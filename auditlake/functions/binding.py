"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inside higher-order functions Spark does not share common subexpressions, so a value used by
    several regular expressions would otherwise be computed again for each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)
