"""The table of known files: what changed, what days that touches, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.content import CATEGORIES, PACKABLE, consistency, is_workload_report

INTERVALS = "array<struct<b:timestamp_ntz,e:timestamp_ntz>>"
CATALOG_SCHEMA = (
    "file_id long, path string, root string, rel string, size long, mtime timestamp, detected string, override string, category string, first_ts timestamp_ntz, "
    f"last_ts timestamp_ntz, days array<date>, error string, sha256 string, report_type string, begin_snap long, end_snap long, db_name string, instance string, time_source string, "
    f"periods {INTERVALS}, lines long, stamped_lines long, ts_mode string, date_source string, stamp_count long, read_as string, intervals {INTERVALS}, `check` string, version string"
)


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def catalog_diff(listing: DataFrame, catalog: DataFrame, version: str | None = None) -> DataFrame:
    """(path, status): new, changed, unchanged or removed, by size and time of each path.

    With `version`, files whose row was made by another version of the analysis count as changed.
    """
    old = catalog.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), *([F.col("version").alias("old_version")] if version else []), F.lit(True).alias("known"))
    both = listing.select("path", "size", "mtime", F.lit(True).alias("listed")).join(old, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    if version:
        same &= F.col("old_version").eqNullSafe(F.lit(version))
    return both.select("path", F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "removed").when(same, "unchanged").otherwise("changed").alias("status"))


def upsert_catalog(new: DataFrame, old: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those of the same path; an override given by hand survives."""
    kept = old.join(new.select("path"), "path", "left_anti")
    if removed is not None:
        kept = kept.join(removed.select("path"), "path", "left_anti")
    by_hand = old.select("path", F.col("override").alias("old_override"), F.col("file_id").alias("old_id"))
    fresh = new.join(by_hand, "path", "left").withColumn("override", F.coalesce("old_override", "override")).withColumn("file_id", F.coalesce("old_id", "file_id"))
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


def set_override(catalog: DataFrame, file_id: int, category: str | None) -> DataFrame:
    """`catalog` with a file's category given by hand, or taken back with None."""
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    mine = F.col("file_id") == file_id
    out = catalog.withColumn("override", F.when(mine, F.lit(category)).otherwise(F.col("override")))
    return out.withColumn("category", F.coalesce("override", "detected"))


def changed_days(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """Days of changed files before and now, of new files, and of removed ones."""
    moved = diff.where("status <> 'unchanged'").select("path")
    days = [c.join(moved, "path", "left_semi").select(F.explode("days").alias("day")) for c in (old, new)]
    return days[0].unionByName(days[1]).distinct()


def other_file_range(files: DataFrame) -> DataFrame:
    """first_ts, last_ts, date_source and check of other files: content, else name with a clock, name's date, file time.

    Expects intervals, read_as, named (`from_name`) and mtime_ts (`trusted_mtime`).
    """
    has = F.size("intervals") > 0
    timed, dated, timely = F.coalesce(F.col("named.has_time"), F.lit(False)), F.col("named.ts").isNotNull(), F.col("mtime_ts").isNotNull()
    first = F.when(has, F.col("intervals")[0]["b"]).when(dated, F.col("named.ts")).otherwise(F.col("mtime_ts"))
    last = (
        F.when(has, F.array_max(F.transform("intervals", lambda i: i["e"])))
        .when(timed, F.col("named.ts"))
        .when(dated, F.col("named.ts") + F.expr("interval 86399 seconds"))
        .otherwise(F.col("mtime_ts"))
    )
    source = F.when(has, "inhalt").when(timed, "dateiname").when(dated, "dateiname (nur Datum)").when(timely, "dateizeit")
    note = F.when(has, consistency(F.col("intervals"), F.col("named"), F.col("mtime_ts"))).otherwise(F.concat(F.lit("no date in the content ("), F.col("read_as"), F.lit(")")))
    return files.withColumn("first_ts", first).withColumn("last_ts", last).withColumn("date_source", source).withColumn("check", note)


def scan_errors(category: Column, lines: Column, stamped: Column, begin: Column, end: Column) -> Column:
    """What is wrong with an analysed file; NULL if nothing."""
    return F.when(category.isin("access", "server") & (lines > 0) & (stamped == 0), "no timestamps found").when((category == "awr") & (begin.isNull() | end.isNull()), "report: begin or end not found")


def scan_stats(diff: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: new (with changed), unchanged, removed, errors."""
    counts = diff.agg(F.count_if(F.expr("status in ('new', 'changed')")).alias("new"), F.count_if(F.expr("status = 'unchanged'")).alias("unchanged"), F.count_if(F.expr("status = 'removed'")).alias("removed"))
    return counts.crossJoin(catalog.agg(F.count("error").alias("errors")))  # a row each


def summary_counts(catalog: DataFrame) -> DataFrame:
    """One row: workload reports, other reports, access logs, server logs, other files with a date."""
    awr = (F.col("category") == "awr") & F.col("first_ts").isNotNull()
    return catalog.agg(
        F.count_if(awr & is_workload_report(F.col("report_type"))).alias("workload_reports"), F.count_if(awr & ~is_workload_report(F.col("report_type"))).alias("other_reports"),
        F.count_if(F.col("category") == "access").alias("access_logs"), F.count_if(F.col("category") == "server").alias("server_logs"),
        F.count_if((F.col("category") == "unknown") & F.col("first_ts").isNotNull()).alias("dated_others"),
    )


def data_days(catalog: DataFrame) -> DataFrame:
    """Days on which packable files have data."""
    return catalog.where(F.col("category").isin(*PACKABLE)).select(F.explode("days").alias("day")).distinct()


def catalog_json(catalog: DataFrame) -> DataFrame:
    """The catalog as JSON, by root and relative path."""
    return catalog.orderBy("root", "rel").select(F.to_json(F.struct(*catalog.columns)).alias("json"))
