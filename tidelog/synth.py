"""Log lines, reports and file heads rendered from the `events` table, so that parsing can be held against its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layout_text(ts: Column, n: Column) -> Column:
    """A log line's head in the layout of number n (0..5), followed by some text."""
    texts = [
        F.concat(F.lit("10.0.0.1 - - ["), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0200] "GET /a HTTP/1.1" 200 17')),
        F.concat(F.lit("####<"), F.date_format(ts, "MMM d, yyyy h:mm:ss"), F.lit(",123 "), F.date_format(ts, "a"), F.lit(" CEST> <Info> <JTA> started")),
        F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss"), F.lit(".500 INFO main - ok")),
        F.concat(F.date_format(ts, "dd.MM.yyyy HH:mm:ss"), F.lit(" Meldung")),
        F.concat(F.lit("audit "), F.date_format(ts, "dd-MMM-yyyy HH:mm:ss"), F.lit(" done")),
        F.concat(F.date_format(ts, "MMM d, yyyy h:mm:ss a"), F.lit(" com.example start")),
    ]
    out = texts[-1]
    for k in range(len(texts) - 2, -1, -1):
        out = F.when(n == k, texts[k]).otherwise(out)
    return out


def event_lines(events: DataFrame, splits: int = 7) -> DataFrame:
    """One log a user: an error event is a continuation line without a time. path, block_start, mid, raw and the event's columns.

    The ids of the events stand for the order; blocks of ids for the splits of a file.
    """
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("\tat com.example.Call("), F.col("event_id").cast("string"), F.lit(")"))).otherwise(layout_text(F.col("ts"), F.col("user_id") % 6))
    size = F.lit(100_000 // splits)
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"), (F.col("event_id") / size).cast("long").alias("block_start"), F.col("event_id").alias("mid"), raw.alias("raw"), "user_id", "event_type",
        F.col("ts").alias("event_ts"),
    )


def hourly(events: DataFrame) -> DataFrame:
    """Per hour: hour, b, e (first and last event in whole seconds), n, dense number of the hour."""
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("b"), F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("e"), F.count(F.lit(1)).alias("n")
    )


def report_texts(hours: DataFrame) -> DataFrame:
    """A report for each hour, of a kind by the hour of the day: hour, kind, text."""
    b, e = F.date_format("b", "dd-MMM-yy HH:mm:ss"), F.date_format("e", "dd-MMM-yy HH:mm:ss")
    dotted = lambda c: F.date_format(c, "dd-MMM-yyyy hh.mm.ss a")
    snap = F.concat(F.lit("Begin Snap:   "), F.col("n").cast("string"), F.lit(" "), b, F.lit("\n  End Snap:   "), (F.col("n") + 1).cast("string"), F.lit(" "), e, F.lit("\n"))
    kinds = {
        "AWR": F.concat(F.lit("WORKLOAD REPOSITORY report for\n\nDB Name         DB Id    Instance\n------------ ----------- --------\nORCL          1234567 orcl1\n\n"), snap),
        "ASH": F.concat(F.lit("ASH Report For ORCL/orcl1\n<table><tr><td>Analysis Begin Time:</td><td>"), b, F.lit("</td></tr><tr><td>Analysis End Time:</td><td>"), e, F.lit("</td></tr></table>")),
        "ADDM": F.concat(F.lit("ADDM Report for Task 'T'\nTime period starts at "), dotted("b"), F.lit("\nTime period ends at "), dotted("e"), F.lit("\n")),
        "Statspack": F.concat(F.lit("STATSPACK report for\n\n"), snap),
        "AWR Compare": F.concat(F.lit("WORKLOAD REPOSITORY COMPARE PERIOD REPORT\n1st "), F.col("n").cast("string"), F.lit(" "), b, F.lit(" (Mon) "), (F.col("n") + 1).cast("string"), F.lit(" "), b, F.lit(" (Mon)\n2nd "), F.col("n").cast("string"), F.lit(" "), e, F.lit(" (Mon) "), (F.col("n") + 1).cast("string"), F.lit(" "), e, F.lit(" (Mon)\n")),
    }
    n, names = F.hour("hour") % len(kinds), list(kinds)
    text, kind = kinds[names[-1]], F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        text, kind = F.when(n == k, kinds[names[k]]).otherwise(text), F.when(n == k, names[k]).otherwise(kind)
    return hours.select("hour", "b", "e", "n", kind.alias("kind"), text.alias("raw"))
