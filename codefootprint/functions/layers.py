"""Adding many derived columns in few projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_layers(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Adds columns that may refer to each other (by names that start with an underscore).

    Columns that do not depend on one another share a projection. Every projection copies the row, texts included, so
    a few wide ones move far less memory than one per column.
    """
    pending = dict(columns)
    while pending:
        ready = {
            name: value for name, value in pending.items()
            if not any(ref in pending for ref in re.findall(r"\b_[a-z_]+", str(value)))
        }
        if not ready:
            raise ValueError(f"columns refer to each other in a circle: {sorted(pending)}")
        df = df.withColumns({n: v if isinstance(v, Column) else F.expr(v) for n, v in ready.items()})
        pending = {n: v for n, v in pending.items() if n not in ready}
    return df
