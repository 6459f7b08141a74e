"""Local names inside a Column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column that is read inside a lambda may be inlined there by the optimizer and then computed
    once per array element. A lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(array: Column) -> Column:
    """Explode a computed array without computing it twice.

    For a plain ``explode`` the optimizer infers a filter on the size of the array and pushes it to
    the scan, which evaluates an expensive array a second time. The outer form is left alone; it gives
    a NULL element for an empty array, which the caller drops.
    """
    return F.explode_outer(array)
