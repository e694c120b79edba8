"""Bind a value once inside an expression."""
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computing ``value`` once.

    A column expression is a tree: a sub-expression written five times runs five
    times inside a lambda, and multiplies again when a filter is pushed through
    the projection that defines it. Binding keeps long text rules linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
