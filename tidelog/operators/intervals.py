"""Time points of contents merged into the stretches that they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import timestamps as T
from tidelog.tables import written

GAP_SECONDS, MOST_INTERVALS, LINE_BYTES = 600, 500, 1_000_000


def content_points(lines: DataFrame, file: str = "path", raw: str = "raw") -> DataFrame:
    """(file, b, e) of every time found in lines: a time covers its minute, a date its day. With repeats."""
    text = F.substring(F.col(raw).cast("binary"), 1, LINE_BYTES).cast("string")
    minute = F.transform(T.find_stamps(text), lambda t: F.struct(F.date_trunc("minute", t).cast("timestamp_ntz").alias("b"), (F.date_trunc("minute", t).cast("timestamp_ntz") + F.expr("interval 59 seconds")).alias("e")))
    day = F.transform(T.find_dates(text), lambda t: F.struct(t.alias("b"), (t + F.expr("interval 86399 seconds")).alias("e")))
    return lines.select(file, F.explode(F.concat(minute, day)).alias("p")).select(file, "p.b", "p.e")


def merge_intervals(points: DataFrame, keys: list[str], gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Points (keys, b, e) merged where the next begins at most `gap_seconds` after all before it end.

    Distinct points are taken first, so a file counts at most its different minutes and days.
    """
    return _merged(points.select(*keys, "b", "e").distinct(), keys, F.lit(gap_seconds)).select(*keys, "b", "e")


def _merged(points: DataFrame, keys: list[str], gap) -> DataFrame:
    """Islands (keys, b, e, gap_before) of points; `gap` is a number or a column of the key.

    Points are dealt by range of key and begin, so that a key may fill any number of parts in a row. Each part says how far
    its points of a key reach, and a row a part and key carries that on to later parts. So every point learns the
    largest end before it; islands begin where that lies further back than the gap, and are numbered in the same two steps.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gapped = points.withColumn("gap", gap)
    dealt = written(gapped.repartitionByRange(parts, *keys, "b", "e").withColumn("place_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "place_part").orderBy("b", "e")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("place_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part and key
    reach = dealt.groupBy(*keys, "place_part").agg(F.max("e").alias("reach")).withColumn("reached", F.max("reach").over(across)).drop("reach")
    top = F.greatest(F.max("e").over(before), F.col("reached"))
    marked = _carried(dealt, reach, keys).withColumn("top", top).withColumn("off", F.timestamp_diff("SECOND", F.col("top"), F.col("b")))
    marked = marked.withColumn("new", (F.col("top").isNull() | (F.col("off") > F.col("gap"))).cast("long"))
    local = written(marked.withColumn("nth", F.sum("new").over(inside)).groupBy(*keys, "place_part", "nth").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.max(F.when(F.col("new") == 1, F.col("off"))).alias("gap_before")))
    number = local.groupBy(*keys, "place_part").agg(F.max("nth").alias("count")).withColumn("islands_before", F.coalesce(F.sum("count").over(across), F.lit(0))).drop("count")
    numbered = _carried(local, number, keys).withColumn("island", F.col("nth") + F.col("islands_before"))
    return numbered.groupBy(*keys, "island").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.max("gap_before").alias("gap_before")).drop("island")


def _carried(rows: DataFrame, of_parts: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with what is known of their part and key (null keys are keys too)."""
    named = of_parts.withColumnsRenamed({c: f"of_{c}" for c in (*keys, "place_part")})
    same = F.lit(True)
    for c in (*keys, "place_part"):
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(named, same).drop(*[f"of_{c}" for c in (*keys, "place_part")])


def cap_intervals(points: DataFrame, keys: list[str], gap_seconds: int = GAP_SECONDS, most: int = MOST_INTERVALS) -> DataFrame:
    """As `merge_intervals`, with the gap doubled until no key has more than `most` stretches.

    Merging again with a doubled gap equals merging all points with it, so the gap follows from the distances between
    neighbours: it is the first doubling that fewer than `most` of them exceed. They are counted by doublings, forty numbers a key.
    """
    base = written(_merged(points.select(*keys, "b", "e").distinct(), keys, F.lit(gap_seconds).cast("long")))
    doublings = [gap_seconds * 2**k for k in range(41)]
    beyond = base.groupBy(*keys).agg(*[F.count_if(F.col("gap_before") > g).alias(f"n{k}") for k, g in enumerate(doublings)])
    fits = F.coalesce(*[F.when(F.col(f"n{k}") < most, F.lit(g).cast("long")) for k, g in enumerate(doublings)])
    wide = beyond.select(*keys, fits.alias("gap")).withColumnsRenamed({c: f"of_{c}" for c in keys}).where(F.col("gap") > gap_seconds)
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    crowded = written(base.join(wide, same).drop(*[f"of_{c}" for c in keys], "gap_before"))
    rest = base.join(wide, same, "left_anti").select(*keys, "b", "e")
    if crowded.isEmpty():
        return rest
    return rest.unionByName(_merged(crowded, keys, F.col("gap")).select(*keys, "b", "e"))


def content_stats(points: DataFrame, file: str = "path") -> DataFrame:
    """Per file: stamps (times and dates found, repeats counted), intervals, first_ts, last_ts, days."""
    counts = points.groupBy(file).agg(F.count(F.lit(1)).alias("stamps"))
    merged = cap_intervals(points, [file]).groupBy(file).agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("intervals"))
    days = F.array_sort(F.array_distinct(F.flatten(F.transform("intervals", lambda i: T.days_between(i["b"], i["e"])))))
    return counts.join(merged, file).select(file, "stamps", "intervals", F.col("intervals")[0]["b"].alias("first_ts"), F.array_max(F.transform("intervals", lambda i: i["e"])).alias("last_ts"), days.alias("days"))
