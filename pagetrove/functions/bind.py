"""Name a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once per row however often ``use`` mentions it.

    Without this, an expression that mentions its input several times is copied into the next
    one several times over, and the plan grows exponentially with the depth.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
