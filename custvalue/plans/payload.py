"""Report tables as one row of parallel arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parallel_arrays(
    order_by: Sequence[str], fields: Mapping[str, str], keep: Column | None = None
) -> dict[str, Column]:
    """Aggregates that gather ``fields`` (output name to column), all in ``order_by`` order.

    ``keep`` limits the rows. For report tables only: their rows are locations, days, weekdays or
    categories, never customers or visits.
    """
    keys = [F.col(name).alias(f"_key_{i}") for i, name in enumerate(order_by)]
    values = [F.col(source).alias(f"_value_{i}") for i, source in enumerate(fields.values())]
    row = F.struct(*keys, *values)
    rows = F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))

    def pick(i: int) -> Column:
        return F.transform(rows, lambda item: item.getField(f"_value_{i}"))

    return {name: pick(i).alias(name) for i, name in enumerate(fields)}


def to_payload(
    df: DataFrame, order_by: Sequence[str], fields: Mapping[str, str] | None = None
) -> DataFrame:
    """A report table as one row with one array per column."""
    chosen = fields or {name: name for name in df.columns}
    return df.agg(*parallel_arrays(order_by, chosen).values())
