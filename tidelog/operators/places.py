"""Places in an order within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.tables import written


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """`df` with `out`: 1, 2, ... by `order` within each group of `keys`.

    Rows are dealt by range of keys and order, so a large group lies in several parts in a row; each part is numbered on its
    own, and the rows of the parts before it are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *keys, *order).withColumn("place_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "place_part").agg(F.count(F.lit(1)).alias("rows_here"))
    before = Window.partitionBy(*keys).orderBy("place_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("rows_before", F.coalesce(F.sum("rows_here").over(before), F.lit(0))).drop("rows_here")
    sizes = sizes.select(*[F.col(c).alias(f"sized_{c}") for c in (*keys, "place_part")], "rows_before")
    same = F.lit(True)
    for key in (*keys, "place_part"):
        same &= F.col(key).eqNullSafe(F.col(f"sized_{key}"))
    joined = dealt.join(sizes, same).drop(*[f"sized_{c}" for c in (*keys, "place_part")])
    place = F.row_number().over(Window.partitionBy(*keys, "place_part").orderBy(*order)) + F.col("rows_before")
    return joined.withColumn(out, place.cast("long")).drop("place_part", "rows_before")
