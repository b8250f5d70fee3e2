"""Integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column | str, b: Column | int) -> Column:
    """Whole-number division, without the detour over doubles."""
    a = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", a.cast("bigint"), b if isinstance(b, Column) else F.lit(b))
