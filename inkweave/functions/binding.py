"""Structs as states of folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])
