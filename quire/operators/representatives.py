"""One surviving record for each group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group_col: str, order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``, which should end in a unique column.

    A window with ``row_number() = 1``: the engine keeps the first row of a group in every
    task before the shuffle, so a group with a third of all rows sends one row a task. Rows
    with a null group form no group.
    """
    window = Window.partitionBy(group_col).orderBy(*order)
    return df.where(F.col(group_col).isNotNull()).withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def merge_fields(df: DataFrame, group_col: str, id_col: str, fields: dict[str, list[Column]], present: dict[str, Column] | None = None) -> DataFrame:
    """A record for each group built field by field, with the id each field came from.

    ``fields`` names each column with its ordering, ``present`` the rows that qualify for it
    (by default those where it is not null). A field without a qualifying row is null.
    """
    present = present or {}
    out = df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.countDistinct(id_col).alias("n_records"))
    for name, order in fields.items():
        fit = df.where(present.get(name, F.col(name).isNotNull()))
        best = top_per_group(fit, group_col, [*order, F.col(id_col)]).select(group_col, F.col(name).alias(name), F.col(id_col).alias(f"{name}_{id_col}"))
        out = out.join(best, group_col, "left")
    return out
