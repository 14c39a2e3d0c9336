"""Plain forms of operators, for small tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.labels import as_inner
from titletags.operators.ordered import TO_CURRENT


def forward_fill_single(
    df: DataFrame, tag: str = "tag", order: str = "row_idx", inner: bool = False
) -> DataFrame:
    """The same fill as one global window: quicker for small tables, but one task."""
    w = Window.orderBy(order).rowsBetween(*TO_CURRENT)
    above = F.last(tag, ignorenulls=True).over(w)
    return df.withColumn(tag, F.coalesce(F.col(tag), as_inner(above) if inner else above))
