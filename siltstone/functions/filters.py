"""Structured filters as nested tuples, which become one predicate that reaches the scan where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ("eq", field, value), ("in", field, values), ("range", field, least, most) with None for an open end,
#: ("starts_with", field, prefix), ("tag", array field, value), ("not", filter), ("all_of", filters), ("any_of", filters).
Filter = tuple


def field(name: str) -> Column:
    """A column, or a key of a map column where the name has a colon, as in metadata:topic."""
    column, _, key = name.partition(":")
    return F.try_element_at(F.col(column), F.lit(key)) if key else F.col(column)


def predicate(spec: Filter) -> Column:
    """Whether a row fits; a null field fits nothing but a negation. No filters fit all rows of all_of, none of any_of."""
    kind, *rest = spec
    if kind == "all_of":
        return reduce(lambda a, b: a & b, map(predicate, rest[0]), F.lit(True))
    if kind == "any_of":
        return reduce(lambda a, b: a | b, map(predicate, rest[0]), F.lit(False))
    if kind == "not":
        return ~predicate(rest[0])
    own, values = field(rest[0]), rest[1:]
    if kind == "eq":
        made = own == F.lit(values[0])
    elif kind == "in":
        made = own.isin(*values[0]) if values[0] else F.lit(False)
    elif kind == "range":
        least, most = values
        made = own.isNotNull()
        made = made if least is None else made & (own >= F.lit(least))
        made = made if most is None else made & (own <= F.lit(most))
    elif kind == "starts_with":
        made = own.startswith(values[0])
    elif kind == "tag":
        made = F.array_contains(own, F.lit(values[0]))
    else:
        raise ValueError(f"no filter of kind {kind}")
    return F.coalesce(made, F.lit(False))
