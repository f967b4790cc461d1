"""Aggregates of a group: the named ways of combining a column, or SQL."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as geo

HOWS = ("any", "most_common", "from_largest", "all", "sum", "average", "min", "max", "count")
NUMERIC_HOWS = ("sum", "average")


@dataclass(frozen=True)
class Aggregate:
    to: str = ""
    column: str | None = None
    how: str | None = None
    expr: str | None = None


def aggregate_sql(agg: Aggregate, geom: str = "geom", row: str = "__src_row") -> str:
    if agg.expr is not None:
        return agg.expr
    c = geo.quote(agg.column) if agg.column else "1"
    text = f"CAST({c} AS STRING)"
    largest = f"greatest({geo.area(geom)}, {geo.length(geom)})"
    return {
        "any": f"any_value({c}, true)",
        # ties go to the lowest value, so the result doesn't depend on row order
        "most_common": f"mode() WITHIN GROUP (ORDER BY {c})",
        "from_largest": f"min_by({c}, named_struct('size', -coalesce({largest}, 0D), 'row', {row})) FILTER (WHERE {c} IS NOT NULL)",
        "all": f"listagg(DISTINCT {text}, ', ') WITHIN GROUP (ORDER BY {text})",
        "sum": f"sum({c})",
        "average": f"avg({c})",
        "min": f"min({c})",
        "max": f"max({c})",
        "count": f"count({c})",
    }[agg.how]


def aggregate_column(agg: Aggregate, geom: str = "geom") -> Column:
    return F.expr(aggregate_sql(agg, geom))
