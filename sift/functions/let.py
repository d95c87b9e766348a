"""Binding of a column's value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform`` binds it to a lambda variable).  CASE branches are outside
    subexpression elimination, so without this each use re-runs the regexes."""
    return F.element_at(F.transform(F.array(value), body), 1)
