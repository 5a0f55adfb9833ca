"""Classification of files by content and name, and small text functions, as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions.timestamps import days_between

CATEGORIES = ("access", "server", "awr", "unknown", "ignore")
PACKABLE, LOGS = ("access", "server", "awr"), ("access", "server")
SNIFF_BYTES, REPORT_BYTES, KIND_BYTES = 64 * 1024, 4 * 1024 * 1024, 8192
#: Report types by content, in order.
REPORT_TYPES = (
    ("AWR Compare", "(?i)WORKLOAD REPOSITORY COMPARE PERIOD REPORT"),
    ("AWR RAC/Global", "(?i)WORKLOAD REPOSITORY (?:RAC|GLOBAL) REPORT"),
    ("AWR", "(?i)WORKLOAD REPOSITORY REPORT"),
    ("ASH", r"(?i)ASH Report\s+For\b"),
    ("ADDM", "(?i)ADDM Report for Task|Automatic Database Diagnostic Monitor"),
    ("Statspack", "(?i)STATSPACK report for"),
)
#: Contents and names that give a category.
ACCESS_REQUEST = r'\[[0-9]{1,2}/\w{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}[^\]]*\]\s+"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s'
W3C_FIELDS = r"(?md)^#Fields:.*(?:cs-method|cs-uri)"
SERVER_LINE = r"(?md)^####<"
REPORT_NAME = r"(?i)awr|ashrpt|addmrpt|^sp_[0-9]|statspack|spreport"
#: Suffixes of archives that are left alone, and of office documents.
JAVA_ARCHIVES = (".ear", ".war", ".jar", ".rar")
OFFICE_SUFFIXES = (".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp", ".vsdx")


def latin(content: Column, size: int = SNIFF_BYTES) -> Column:
    """The first bytes of a content, one character each."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def compression(content: Column) -> Column:
    """gz, bz2, xz or NULL by the first bytes."""
    head = F.hex(F.substring(content, 1, 6))
    return F.when(head.startswith("1F8B"), "gz").when(head.startswith("425A68"), "bz2").when(head == "FD377A585A00", "xz")


def logical_name(name: Column) -> Column:
    """A file name without one compression suffix."""
    return F.regexp_replace(name, r"(?i)\.(gz|bz2|xz)$", "")


def content_kind(content: Column, name: Column) -> Column:
    """pdf, office, binary or text; unreadable (NULL) contents are binary."""
    head = latin(content, KIND_BYTES)
    office = F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in OFFICE_SUFFIXES) + ")$")
    return (
        F.when(content.isNull(), "binary")
        .when(head.startswith("%PDF"), "pdf")
        .when(head.startswith("PK\x03\x04") & office, "office")
        .when(F.call_function("instr", head, F.call_function("chr", F.lit(0))) > 0, "binary")
        .otherwise("text")
    )


def report_type(head: Column) -> Column:
    """Type of an Oracle report by its text, the first that fits; NULL for others."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(REPORT_TYPES):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def classify(name: Column, head: Column) -> Column:
    """Category of a file by the first bytes of its content (`latin`), then by its name."""
    name = logical_name(name)
    low = F.lower(name)
    report_file = name.rlike(REPORT_NAME) & low.rlike(r"\.(html|htm|txt|lst)$")
    return (
        F.when(low.rlike("(" + "|".join(s.replace(".", r"\.") for s in JAVA_ARCHIVES) + ")$"), "ignore")
        .when(report_type(head).isNotNull(), "awr")
        .when(head.rlike(ACCESS_REQUEST) | head.rlike(W3C_FIELDS), "access")
        .when(head.rlike(SERVER_LINE), "server")
        .when(report_file, "awr")
        .when(name.rlike(r"(?i)access.*\.log"), "access")
        .when(name.rlike(r"(?i)server.*\.log"), "server")
        .otherwise("unknown")
    )


def effective_category(override: Column, detected: Column) -> Column:
    """The category given by hand, or the detected one; an unknown name raises an error."""
    known = override.isNull() | override.isin(*CATEGORIES)
    return F.when(known, F.coalesce(override, detected)).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), override)).cast("string"))


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def report_text(text: Column) -> Column:
    """Text of a report: HTML without tags and entities; runs of blanks are one, line ends stay."""
    is_html = (F.instr(F.lower(F.substring(text, 1, 4096)), "<html") > 0) | (F.instr(F.lower(text), "<table") > 0)
    plain = F.when(is_html, html_unescape(F.regexp_replace(text, "<[^>]+>", " "))).otherwise(text)
    return F.regexp_replace(plain, r"[ \t\r\f\x0B]+", " ")


def is_workload_report(kind: Column) -> Column:
    """Reports that define a window of their own; one without a type counts as one."""
    return F.upper(F.coalesce(F.nullif(kind, F.lit("")), F.lit("AWR"))).startswith("AWR")


def consistency(intervals: Column, named: Column, mtime: Column) -> Column:
    """Whether the day in the file name, or else the file's own day, is among the days of the content."""
    days = F.flatten(F.transform(intervals, lambda i: days_between(i["b"], i["e"])))
    off_name = named["ts"].isNotNull() & ~F.array_contains(days, F.to_date(named["ts"]))
    off_time = named["ts"].isNull() & mtime.isNotNull() & ~F.array_contains(days, F.to_date(mtime))
    note = F.when(off_name, F.concat(F.lit("file name says "), F.to_date(named["ts"]).cast("string"))).when(off_time, F.concat(F.lit("file time "), F.to_date(mtime).cast("string")))
    return F.when(note.isNull(), "content fits").otherwise(F.concat(F.lit("content decides – differs: "), note))


def entry_name(category: Column, root: Column, rel: Column, strip: bool) -> Column:
    """category/[root unless inbox]/directories/name; `strip` drops a compression suffix."""
    rel = logical_name(rel) if strip else rel
    return F.concat_ws("/", category, F.when(root != "inbox", root), rel)


def check_text(lines: Column, total: Column, mode: Column) -> Column:
    """How many of a log's lines lie in the window."""
    return F.format_string("zeilengenau: %d von %s Zeilen im Zeitraum (Zeitstempel: %s)", lines, F.coalesce(total.cast("string"), F.lit("?")), F.coalesce(mode, F.lit("Zeilenanfang")))
