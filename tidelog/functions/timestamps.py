"""Timestamps in log lines, report texts and file names, as Column expressions.

All results are TIMESTAMP_NTZ: local time as written, zone offsets left aside, whole seconds. A text that no layout fits, or
whose parts form no valid date, gives NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months by their first three letters, English and German.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}
#: Bytes of a line in which a leading timestamp is sought, and of a line searched as a whole.
HEAD_BYTES, WHOLE_LINE_BYTES = 256, 64 * 1024
#: White space as in Unicode, which Java's \s is not.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_MONTH = r"([A-Za-zäÄ]{3,4})\.?"
_CLOCK = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[,.][0-9]+)?" + WS + r"?([AaPp][Mm])?"


@dataclass(frozen=True)
class Layout:
    """A pattern and the order of year, month, day, hour, minute, second and half of day in its groups ("" if absent)."""

    name: str
    pattern: str
    parts: str
    named_month: bool
    #: Characters that every match holds: a line without them isn't searched.
    needs: str = ""


#: Layouts, tried in this order. Digits are [0-9] throughout: \d of Python is wider than that of Java, and no
#: other digits make a valid date in either.
LAYOUTS = (
    Layout("clf", r"\[([0-9]{1,2})/" + _MONTH + r"/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2})", "$3|$2|$1|$4|$5|$6|", True, "[/:"),
    Layout("bracket", "<" + _MONTH + r" ([0-9]{1,2}),? ([0-9]{4}),? " + _CLOCK, "$3|$1|$2|$4|$5|$6|$7", True, "<:"),
    Layout("iso", r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T|" + WS + r")([0-9]{2}):([0-9]{2}):([0-9]{2})", "$1|$2|$3|$4|$5|$6|", False, "-:"),
    Layout("german", r"([0-9]{2})\.([0-9]{2})\.([0-9]{4}),?" + WS + r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?", "$3|$2|$1|$4|$5|$6|", False, ".:"),
    Layout("oracle", r"([0-9]{1,2})-" + _MONTH + r"-([0-9]{2,4})" + WS + r"([0-9]{2}):([0-9]{2}):([0-9]{2})", "$3|$2|$1|$4|$5|$6|", True, "-:"),
    Layout("english", r"(?<![\p{L}\p{N}_])" + _MONTH + r" ([0-9]{1,2}),? ([0-9]{4}),? " + _CLOCK, "$3|$1|$2|$4|$5|$6|$7", True, ":"),
)
#: Dates without a clock.
DATE_LAYOUTS = (
    Layout("iso_date", r"(?<![0-9])(20[0-9]{2})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(?!(?:[T:.]|" + WS + r")?[0-9])", "$1|$2|$3||||", False, "-"),
    Layout("german_date", r"(?<![0-9])(0[1-9]|[12][0-9]|3[01])\.(0[1-9]|1[0-2])\.(20[0-9]{2})(?!(?:,|" + WS + r")*[0-9]{1,2}[:.][0-9])", "$3|$2|$1||||", False, "."),
)
_NAME_TIME = r"(?:[T_\-. ]?([01][0-9]|2[0-3])[:.\-h]?([0-5][0-9])(?:[:.\-]?([0-5][0-9]))?)?"
#: Dates and times in file names.
NAME_LAYOUTS = (
    Layout("name_iso", r"(?<![0-9])(20[0-9]{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12][0-9]|3[01])" + _NAME_TIME + r"(?![0-9])", "$1|$2|$3|$4|$5|$6|", False),
    Layout("name_german", r"(?<![0-9])(0[1-9]|[12][0-9]|3[01])\.(0[1-9]|1[0-2])\.(20[0-9]{2})" + _NAME_TIME + r"(?![0-9])", "$3|$2|$1|$4|$5|$6|", False),
)
ORACLE_TIME = r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4}" + WS + r"+[0-9]{1,2}[:.][0-9]{2}(?:[:.][0-9]{2})?(?:" + WS + r"*[AaPp][Mm])?"
_ORACLE = Layout(
    "oracle_report", r"([0-9]{1,2})-([A-Za-z]{3})-([0-9]{2,4})" + WS + r"+([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2}))?" + WS + r"*([AaPp][Mm])?", "$3|$2|$1|$4|$5|$6|$7", True
)


def month_of(name: Column) -> Column:
    """Number of a month by the first three letters of its name; NULL for others."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(months, F.lower(F.substring(name, 1, 3)))


def hour12(hour: Column, half: Column) -> Column:
    """Hour of the day from a 12-hour clock; `half` is AM, PM (either case) or empty."""
    half = F.upper(half)
    return F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _made(parts: Column, layout: Layout) -> Column:
    """A timestamp of an array of year, month, day, hour, minute, second and half of day."""
    year, hour, second = _int(parts[0]), _int(F.coalesce(F.nullif(parts[3], F.lit("")), F.lit("0"))), _int(F.coalesce(F.nullif(parts[5], F.lit("")), F.lit("0")))
    year = F.when(year < 100, year + 2000).otherwise(year) if layout.name.startswith("oracle") else F.when(year >= 1, year)
    month = month_of(parts[1]) if layout.named_month else _int(parts[1])
    minute = _int(F.coalesce(F.nullif(parts[4], F.lit("")), F.lit("0")))
    if layout.name == "oracle_report":
        hour = F.when(F.upper(parts[6]) == "PM", hour % 12 + 12).when(F.upper(parts[6]) == "AM", hour % 12).otherwise(hour)
    else:
        hour = hour12(hour, parts[6])
    whole = F.array(year, month, _int(parts[2]), hour, minute, second)
    return bound(whole, lambda p: F.when(_valid(p), F.try_make_timestamp_ntz(p[0], p[1], p[2], p[3], p[4], p[5].cast("decimal(16,6)"))))


def _valid(p: Column) -> Column:
    """Whether year, month, day, hour, minute and second form a time: asked beforehand, as a failing constructor costs far more."""
    leap = (p[0] % 4 == 0) & ((p[0] % 100 != 0) | (p[0] % 400 == 0))
    days = F.when(p[1].isin(4, 6, 9, 11), 30).when(p[1] != 2, 31).when(leap, 29).otherwise(28)
    return p[1].between(1, 12) & p[2].between(1, days) & p[3].between(0, 23) & p[4].between(0, 59) & p[5].between(0, 59)


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(match: Column, layout: Layout) -> Column:
    """The timestamp of a text that is a match of the layout's pattern as a whole."""
    return bound(F.split(F.regexp_replace(match, layout.pattern, layout.parts), r"\|"), lambda parts: _made(parts, layout))


def holds(text: Column, layout: Layout) -> Column:
    """Whether a text holds all characters that the layout needs: a cheap test before its pattern is sought."""
    out = F.lit(True)
    for c in layout.needs:
        out &= F.contains(text, F.lit(c))
    return out


def first_of(text: Column, layout: Layout) -> Column:
    """The first match of one layout; NULL if there is none or it is no valid date."""
    match = F.when(holds(text, layout), F.regexp_substr(text, F.lit(layout.pattern)))
    return bound(match, lambda m: F.when(m.isNotNull(), parsed(m, layout)))


def parse_text(text: Column) -> Column:
    """The first layout, in order, whose first match is a valid time."""
    return bound(text, lambda t: F.coalesce(*[first_of(t, layout) for layout in LAYOUTS]))


def first_stamp(text: Column) -> Column:
    """STRUCT<layout, ts> of `parse_text`; layouts behind the first that fits aren't sought."""

    def found(t: Column, layout: Layout) -> Column:
        return bound(first_of(t, layout), lambda ts: F.when(ts.isNotNull(), F.struct(F.lit(layout.name).alias("layout"), ts.alias("ts"))))

    return bound(text, lambda t: F.coalesce(*[found(t, layout) for layout in LAYOUTS]))


def line_head(raw: Column) -> Column:
    """The part of a raw line that is searched for a leading timestamp."""
    return F.substring(raw.cast("binary"), 1, HEAD_BYTES).cast("string")


def plausible(ts: Column) -> Column:
    return (ts >= F.lit("2000-01-01").cast("timestamp_ntz")) & (ts < F.lit("2100-01-01").cast("timestamp_ntz"))


def _all(text: Column, layouts: tuple[Layout, ...]) -> Column:
    def of(t: Column, layout: Layout) -> Column:
        found = F.when(holds(t, layout), F.regexp_extract_all(t, F.lit(layout.pattern), F.lit(0))).otherwise(F.when(t.isNotNull(), F.array().cast("array<string>")))
        return F.transform(found, lambda m: parsed(m, layout))

    return bound(text, lambda t: F.filter(F.concat(*[of(t, layout) for layout in layouts]), plausible))


def find_stamps(text: Column) -> Column:
    """All times with a clock, layout by layout and then by place; one text can fit two layouts and then counts twice."""
    return _all(text, LAYOUTS)


def find_dates(text: Column) -> Column:
    """All dates without a clock."""
    return _all(text, DATE_LAYOUTS)


def parse_line_whole(raw: Column) -> Column:
    """The first of `find_stamps` anywhere in the line."""
    text = F.substring(raw.cast("binary"), 1, WHOLE_LINE_BYTES).cast("string")

    def first(t: Column, layout: Layout) -> Column:
        found = F.when(holds(t, layout), F.regexp_extract_all(t, F.lit(layout.pattern), F.lit(0)))
        return F.get(F.filter(F.transform(found, lambda m: parsed(m, layout)), plausible), F.lit(0))

    return bound(text, lambda t: F.coalesce(*[first(t, layout) for layout in LAYOUTS]))


def parse_oracle(value: Column) -> Column:
    """Oracle's report times: 27-Sep-26 10:00:05, 27-SEP-26 10.00.05 AM, 27-Sep-26 10:00; sought at the start only."""
    trimmed = F.regexp_replace(value, f"^{WS}+", "")
    return parsed(F.regexp_substr(trimmed, F.lit("^" + _ORACLE.pattern)), _ORACLE)


def from_name(name: Column) -> Column:
    """STRUCT<ts, has_time> of the date in a file name; an ISO-like hit that is no date is final."""
    iso, german = (F.regexp_substr(name, F.lit(layout.pattern)) for layout in NAME_LAYOUTS)

    def of(match: Column, layout: Layout) -> Column:
        parts = F.split(F.regexp_replace(match, layout.pattern, layout.parts), r"\|")
        found = bound(parts, lambda p: F.struct(_made(p, layout).alias("ts"), (p[3] != "").alias("has_time")))
        return F.when(found["ts"].isNotNull(), found)

    return F.when(iso.isNotNull(), of(iso, NAME_LAYOUTS[0])).otherwise(of(german, NAME_LAYOUTS[1]))


def trusted_mtime(mtime: Column) -> Column:
    """A file time in whole local seconds, unless it lies before 2000."""
    return F.when(mtime >= F.lit("2000-01-01").cast("timestamp"), F.date_trunc("second", mtime).cast("timestamp_ntz"))


def days_between(begin: Column, end: Column) -> Column:
    """All days that a closed range touches; none if it is reversed or NULL."""
    return F.when(begin <= end, F.sequence(F.to_date(begin), F.to_date(end))).otherwise(F.array().cast("array<date>"))


def range_name(begin: Column, end: Column) -> Column:
    """yyyy-MM-dd_HHmm-HHmm, or the full date on both sides over midnight."""
    first = F.date_format(begin, "yyyy-MM-dd_HHmm")
    last = F.when(F.to_date(begin) == F.to_date(end), F.date_format(end, "HHmm")).otherwise(F.date_format(end, "yyyy-MM-dd_HHmm"))
    return F.concat(first, F.lit("-"), last)
