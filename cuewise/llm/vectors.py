"""What both vector searches share: the rows that take part, and bounded groups of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def vector_rows(table: DataFrame, id_column: str, vector_column: str, component, queries) -> DataFrame:
    """(vec_id, v, dim, query) of the distinct usable rows; ``component`` maps one component, ``queries`` tells which ids ask."""
    vector = F.col(vector_column).cast("array<double>")
    rows = table.where(usable(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, component).alias("v"))
    rows = rows.dropDuplicates(["vec_id", "v"])
    return stored(rows.select("vec_id", "v", F.size("v").alias("dim"), queries(F.col("vec_id")).alias("query")))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of every query; each candidate counts once."""
    from pyspark.sql import Window

    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
