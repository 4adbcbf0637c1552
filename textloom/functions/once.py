"""Costly columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, whatever uses them later.

    The optimizer moves filters below projections by putting the column's whole
    expression into the filter, so a costly column that is filtered and returned
    is computed twice, and one built on another more often.  A generator of one
    row stops that; it is code-generated and adds no exchange.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
