"""Columns that are computed once, whatever is done with them later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with costly columns that later filters and joins do not recompute.

    The optimizer moves a filter on a derived column below the projection that derives it, and
    spells the whole expression out again: a hundred word lookups, each on its own lower-cased
    copy of the prompt, in one condition too large to be compiled.  It does not move a filter
    below a generator, so the columns are made by unfolding an array of one struct.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(values)))
