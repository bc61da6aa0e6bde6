"""Names for values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, worked out once for each row however often body names it.

    Plain reuse of a column repeats its whole expression, and branches of a CASE are not shared by the code generator.
    """
    return F.get(F.transform(F.array(value), body), 0)
