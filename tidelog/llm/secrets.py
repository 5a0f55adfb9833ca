"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length of it. Listed order is the order of kinds.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are the longest runs of `alphabet` of `window` characters or more; one whose windows reach `bits` a character is reported."""

    kind: str
    run: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]", "0123456789ABCDEFabcdef", 20, 3.0),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.85),
)
#: Candidates that match one of these are no secrets: words and joined words, numbers, UUIDs, placeholders.
ALLOWED = (
    r"[A-Za-z+/_=-]*",
    r"[0-9+/_=-]*",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(example|placeholder|changeme|dummy|xxxx|0000|1234567).*",
)
SCALE = 1_000_000
BLOCK = 256
LAST = 2**31 - 1


def weighted_log(count: int) -> int:
    """count * log2(count) in millionths, so that sums are exact in any order."""
    return round(count * math.log2(count) * SCALE) if count else 0


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)`, with `value` evaluated once however often, and in whatever lambda, it is used there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def in_blocks(values: Column) -> Column:
    """The elements in arrays of `BLOCK`."""
    return bound(
        values,
        lambda v: F.when(
            F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        ).otherwise(F.slice(F.array(v), 1, 0)),
    )


def running(values: Column, combined: Callable[[Column, Column], Column], start: int) -> Column:
    """What `combined`, an associative function of ints with the neutral `start`, makes of each element and all before it.

    Blocks are run through on their own, then their results, so that arrays aren't copied for each element.
    """

    def through(part: Column) -> Column:
        none = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("before"), F.array().cast("array<int>").alias("seen"))

        def step(s: Column, x: Column) -> Column:
            at = combined(s["at"], x)
            return F.struct(at.alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before"), F.concat(s["seen"], F.array(at)).alias("seen"))

        return F.aggregate(part, none, step)

    def carried(blocks: Column) -> Column:
        before = through(F.transform(blocks, lambda b: b["at"]))["before"]
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["seen"], lambda x: combined(at, x))))

    return bound(F.transform(in_blocks(values), through), carried)


def outside(found: Column, spans: Column) -> Column:
    """Those of `found` (start, end, value) that no span overlaps: one sort of both, and one pass from either side.

    A span that begins before or with a match overlaps it if it ends behind the match's start; one that begins later, if it
    begins before the match's end.
    """
    event = lambda s, own, value: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), value.alias("value"))
    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, 0, F.lit(""))), F.transform(found, lambda s: event(s, 1, s["value"]))))

    def kept(rows: Column) -> Column:
        ended = running(F.transform(rows, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), F.greatest, 0)
        begun = F.reverse(running(F.reverse(F.transform(rows, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(LAST))), F.least, LAST))
        near = F.zip_with(F.zip_with(rows, ended, lambda e, at: F.struct(e.alias("e"), at.alias("ended"))), begun, lambda x, at: F.struct(x["e"].alias("e"), x["ended"].alias("ended"), at.alias("begun")))
        free = F.filter(near, lambda x: (x["e"]["own"] == 1) & (x["ended"] <= x["e"]["start"]) & (x["begun"] >= x["e"]["end"]))
        return F.transform(free, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["value"].alias("value")))

    return F.when(F.size(found) > 0, bound(events, kept)).otherwise(found)


def located(docs: DataFrame, out: str, text: Column, pattern: str, group: int = 0, least: int = 0, value: bool = False) -> DataFrame:
    """Adds `out`: structs (start, end, value) of the leftmost matches of `pattern` whose `group` has `least` characters.

    The texts between matches and the matches themselves alternate, so the sums of their lengths are the places.
    """
    rx = F.lit(pattern)
    docs = docs.withColumn(f"{out}_m", F.regexp_extract_all(text, rx, F.lit(0)))
    if group:
        docs = docs.withColumn(f"{out}_v", F.regexp_extract_all(text, rx, F.lit(group)))
    found = F.col(f"{out}_m")
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn(f"{out}_g", F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.length(g)))
    docs = docs.withColumn(f"{out}_e", running(F.zip_with(f"{out}_g", F.col(f"{out}_m"), lambda g, m: g + F.length(m)), lambda x, y: x + y, 0))
    counted = F.col(f"{out}_v") if group else F.col(f"{out}_m")
    spans = F.zip_with(
        F.zip_with(f"{out}_e", F.col(f"{out}_m"), lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))),
        counted,
        lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.length(c).alias("n")),
    )
    kept = F.transform(
        F.filter(spans, lambda s: s["n"] >= least),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *([s["value"].alias("value")] if value else [])),
    )
    return docs.withColumn(out, kept).drop(*[f"{out}_{x}" for x in "mgev"])


def least_log_sum(value: Column, of: EntropyClass) -> Column:
    """Least sum of count * log2(count) over the windows of a candidate: that of the window of highest entropy.

    Counts and sum slide: each step drops the leaving character, adds the entering one and adjusts the sum by the two
    counts that changed.
    """
    w = of.window
    table = F.array(*[F.lit(weighted_log(c)).cast("long") for c in range(w + 1)])
    chars = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(of.alphabet), c))
    codes = F.filter(chars, lambda c: c > 0)
    start = F.struct(
        F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.array().cast("array<int>").alias("seen"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least")
    )

    def step(s: Column, enters: Column) -> Column:
        full = F.size(s["seen"]) == w
        leaves = F.when(full, F.element_at(s["seen"], 1)).otherwise(F.lit(0))
        less = F.when(full, F.element_at(s["counts"], leaves)).otherwise(F.lit(0))
        left = s["sum"] + F.when(full, F.get(table, less - 1) - F.get(table, less)).otherwise(F.lit(0).cast("long"))
        more = F.element_at(s["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
        total = left + F.get(table, more + 1) - F.get(table, more)
        counts = F.transform(s["counts"], lambda c, i: c + F.when(i + 1 == enters, 1).otherwise(0) - F.when(i + 1 == leaves, 1).otherwise(0))
        seen = F.concat(F.when(full, F.slice(s["seen"], 2, w - 1)).otherwise(s["seen"]), F.array(enters))
        complete = F.size(s["seen"]) >= w - 1
        return F.struct(counts.alias("counts"), seen.alias("seen"), total.alias("sum"), F.when(complete, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

    return F.aggregate(codes, start, step)["least"]


def reaches(of: EntropyClass):
    """Whether the windows of a candidate struct reach the entropy of the class."""
    limit = int(of.window * (math.log2(of.window) - of.bits) * SCALE)
    return lambda s: least_log_sum(s["value"], of) <= limit


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """`docs` with `out_col`: array of (start, rank, end, kind), in code points, end exclusive, by start and then by kind.

    First the fixed patterns, leftmost and not overlapping within a kind. Then candidates of each entropy class outside
    all spans so far: a candidate is reported whole when some window reaches the class's entropy and no allow-list
    pattern matches all of it. A null or empty text has no spans. Rows are handled one by one, without a shuffle;
    built-in functions only. A column named `out_col` is replaced, all others are carried along whatever their names.
    """
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out_col]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))

    def tagged(name: str, rank: int, kind: str) -> Column:
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        work = located(work, f"x_{kind}", F.col("t"), pattern, group, least)
    work = work.withColumn("spans", F.concat(*[tagged(f"x_{kind}", rank, kind) for rank, (kind, *_) in enumerate(PATTERNS)]))
    for rank, of in enumerate(classes, len(PATTERNS)):
        work = located(work, "c", F.col("t"), f"{of.run}{{{of.window},}}", value=True)
        free = outside(F.col("c"), F.col("spans"))
        listed = "|".join(f"(?:{pattern})" for pattern in allowed)
        free = F.filter(free, lambda s: ~s["value"].rlike(f"^(?:{listed})$")) if allowed else free
        work = work.withColumn("c", free).withColumn("c", F.filter("c", reaches(of)))
        work = work.withColumn("spans", F.concat("spans", tagged("c", rank, of.kind))).drop("c")
    return work.select("row.*", F.array_sort("spans").alias(out_col))


def joined_spans(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with each span of `spans`, which are in the order of their starts, replaced; overlapping spans become one mask.

    The text before a span is cut from that of its block of spans, so that a long text isn't counted through for each span.
    """
    ends = F.transform(spans, lambda s: s["end"])
    gaps = F.zip_with(spans, running(ends, F.greatest, 0), lambda s, at: F.struct(s["start"].alias("start"), at.alias("reached")))
    before = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["reached"]))
    gaps = F.filter(F.zip_with(gaps, F.slice(before, F.lit(1), F.size(spans)), lambda g, at: F.struct(at.alias("at"), g["start"].alias("start"))), lambda g: g["start"] >= g["at"])

    def cut(part: Column) -> Column:
        first = F.get(part, F.lit(0))["at"]
        whole = F.substring(text, first + 1, F.element_at(part, -1)["start"] - first)
        return bound(whole, lambda t: F.array_join(F.transform(part, lambda g: F.concat(F.substring(t, g["at"] - first + 1, g["start"] - g["at"]), F.lit(mask))), ""))

    done = F.concat(F.array_join(F.transform(in_blocks(gaps), cut), ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
