"""Periods, snapshots and database of Oracle performance reports, as Column expressions over a report's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timestamps import ORACLE_TIME, WS, days_between, parse_oracle

#: The lines that hold a report's period.
SNAP = rf"(Begin|End) Snap:{WS}+([0-9]+){WS}+([^\s]+{WS}+[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})"
ANALYSIS = rf"Analysis (Begin|End) Time:{WS}+([^\s]+{WS}+[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})"
ADDM = rf"(?is)Time period starts at{WS}+({ORACLE_TIME}).*?Time period ends at{WS}+({ORACLE_TIME})"
COMPARE_ROW = (
    rf"(?i)(?<![\p{{L}}\p{{N}}_])(1st|2nd)\)?{WS}+(?:[A-Za-z_][\w$#]*{WS}+)?([0-9]+){WS}+({ORACLE_TIME})(?:{WS}*\([\w]{{2,3}}\))?{WS}+([0-9]+){WS}+({ORACLE_TIME})"
)
DATABASE = rf"(?s)DB Name{WS}+DB Id.*?\n{WS}*(?:[-\s]+\n{WS}*)?([^\s]+){WS}+([0-9]+){WS}+([^\s]+)"
FALLBACK_CHARS = 20_000


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _range(b: Column, e: Column) -> Column:
    return F.struct(b.alias("b"), e.alias("e"))


def snap_interval(text: Column) -> Column:
    """STRUCT<b, e, begin_snap, end_snap>: the earliest Begin Snap and the latest End Snap, the first of equal ones."""
    rows = F.zip_with(
        F.zip_with(_found(text, SNAP, 1), _found(text, SNAP, 2), lambda k, i: F.struct(k.alias("kind"), i.try_cast("bigint").alias("id"))),
        _found(text, SNAP, 3),
        lambda s, t: F.struct(s["kind"].alias("kind"), s["id"].alias("id"), parse_oracle(t).alias("ts")),
    )
    placed = F.filter(F.transform(rows, lambda r, i: F.struct(r["ts"].alias("ts"), i.alias("at"), r["id"].alias("id"), r["kind"].alias("kind"))), lambda r: r["ts"].isNotNull())
    first = F.array_min(F.filter(placed, lambda r: r["kind"] == "Begin"))
    ends = F.filter(placed, lambda r: r["kind"] == "End")
    last = F.array_max(F.transform(ends, lambda r: F.struct(r["ts"].alias("ts"), (-r["at"]).alias("at"), r["id"].alias("id"))))
    return F.struct(first["ts"].alias("b"), last["ts"].alias("e"), first["id"].alias("begin_snap"), last["id"].alias("end_snap"))


def compare_periods(text: Column) -> Column:
    """The first valid 1st and 2nd row of a comparison, as sorted periods; NULL if there is none."""
    times = F.zip_with(_found(text, COMPARE_ROW, 3), _found(text, COMPARE_ROW, 5), lambda b, e: _range(parse_oracle(b), parse_oracle(e)))
    rows = F.zip_with(_found(text, COMPARE_ROW, 1), times, lambda k, r: F.struct(F.lower(k).alias("label"), r["b"].alias("b"), r["e"].alias("e")))
    valid = F.filter(rows, lambda r: r["b"].isNotNull() & r["e"].isNotNull())
    one = [F.slice(F.filter(valid, _labelled(label)), 1, 1) for label in ("1st", "2nd")]
    found = F.array_sort(F.transform(F.concat(*one), lambda r: _range(r["b"], r["e"])))
    return F.when(F.size(found) > 0, found)


def _labelled(label: str):
    return lambda r: r["label"] == label


def analysis_interval(text: Column) -> Column:
    """STRUCT<b, e>: the last Analysis Begin Time and End Time; NULL unless both are valid."""
    rows = F.zip_with(_found(text, ANALYSIS, 1), _found(text, ANALYSIS, 2), lambda k, t: F.struct(k.alias("kind"), parse_oracle(t).alias("ts")))

    def last(kind: str) -> Column:
        return F.try_element_at(F.filter(rows, lambda r: r["kind"] == kind), F.lit(-1))["ts"]

    b, e = last("Begin"), last("End")
    return F.when(b.isNotNull() & e.isNotNull(), _range(b, e))


def addm_interval(text: Column) -> Column:
    """STRUCT<b, e> of the first "Time period starts at … ends at …"; NULL if there is none."""
    whole = F.regexp_substr(text, F.lit(ADDM))
    return F.when(whole.isNotNull(), _range(parse_oracle(F.regexp_extract(whole, ADDM, 1)), parse_oracle(F.regexp_extract(whole, ADDM, 2))))


def fallback_interval(text: Column) -> Column:
    """STRUCT<b, e>: the first and last of two or more times in the head of the text."""
    times = F.filter(F.transform(_found(F.substring(text, 1, FALLBACK_CHARS), "(?i)" + ORACLE_TIME, 0), parse_oracle), lambda t: t.isNotNull())
    return F.when(F.size(times) >= 2, _range(F.array_min(times), F.array_max(times)))


def database(text: Column) -> Column:
    """STRUCT<db_name, instance> from the header table."""
    whole = F.regexp_substr(text, F.lit(DATABASE))
    return F.struct(F.regexp_extract(whole, DATABASE, 1).alias("db_name"), F.regexp_extract(whole, DATABASE, 3).alias("instance"))


def parse_reports(reports: DataFrame, text_col: str = "text", type_col: str = "report_type") -> DataFrame:
    """Adds begin, end, begin_snap, end_snap, db_name, instance, time_source, periods and days to reports.

    Sources in order: snapshots, comparison rows (of comparisons only, which then have two periods), analysis times, the
    ADDM sentence, any two times in the head. A later source counts only where begin or end is missing so far.
    """
    t = F.col(text_col)
    out = reports.withColumn("s", snap_interval(t)).withColumn("c", F.when(F.col(type_col) == "AWR Compare", compare_periods(t)))
    out = out.withColumn("b0", F.when(F.col("c").isNull(), F.col("s.b")).otherwise(F.array_min(F.transform("c", lambda p: p["b"]))))
    out = out.withColumn("e0", F.when(F.col("c").isNull(), F.col("s.e")).otherwise(F.array_max(F.transform("c", lambda p: p["e"]))))
    out = out.withColumn("k0", F.when(F.col("b0").isNotNull() & F.col("e0").isNotNull(), "snapshot"))
    for n, (find, kind) in enumerate(((analysis_interval, "analysis"), (addm_interval, "analysis"), (fallback_interval, "fallback"))):
        missing = F.col(f"b{n}").isNull() | F.col(f"e{n}").isNull()
        out = out.withColumn("f", F.when(missing, find(t)))
        use = F.col("f").isNotNull()
        out = (
            out.withColumn(f"b{n + 1}", F.when(use, F.col("f.b")).otherwise(F.col(f"b{n}")))
            .withColumn(f"e{n + 1}", F.when(use, F.col("f.e")).otherwise(F.col(f"e{n}")))
            .withColumn(f"k{n + 1}", F.when(use, kind).otherwise(F.col(f"k{n}")))
        )
    whole = F.col("b3").isNotNull() & F.col("e3").isNotNull()
    out = out.withColumn("periods", F.coalesce("c", F.when(whole, F.array(_range(F.col("b3"), F.col("e3"))))))
    out = out.withColumn("d", database(t))
    days = F.array_sort(F.array_distinct(F.flatten(F.transform("periods", lambda p: days_between(p["b"], p["e"])))))
    return out.select(
        *[F.col(f"`{c}`") for c in reports.columns], F.col("b3").alias("begin"), F.col("e3").alias("end"), F.col("s.begin_snap").alias("begin_snap"), F.col("s.end_snap").alias("end_snap"),
        F.col("d.db_name").alias("db_name"), F.col("d.instance").alias("instance"), F.col("k3").alias("time_source"), "periods", days.alias("days"),
    )
