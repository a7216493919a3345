"""Column helpers over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row.

    A column used inside a lambda may be put there as its whole expression and
    run once per element; a lambda variable bound to it may not.
    """
    # A fold over nothing. An array item would ask for its type, that is the type of the whole
    # expression below it, once per row.
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, then)
