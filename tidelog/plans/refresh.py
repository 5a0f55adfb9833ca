"""Scanning, analysing and keeping packages current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions import content as C
from tidelog.functions import timestamps as T
from tidelog.functions.reports import parse_reports
from tidelog.operators import assign, intervals
from tidelog.operators import catalog as K
from tidelog.operators import lines as L
from tidelog.plans.windows import Plan
from tidelog.sources import files as S
from tidelog.sources import packed
from tidelog.tables import written

VERSION = "2"


@F.pandas_udf(StringType())
def packed_sha256(contents):
    """SHA-256 of each compressed content after decompression; NULL if it can't be read."""
    import hashlib
    import lzma
    import zlib

    def one(body):
        digest = hashlib.sha256()
        try:
            for chunk in S.chunks_of(S.stream_of("", body)[0]):
                digest.update(chunk)
            return digest.hexdigest()
        except (OSError, EOFError, lzma.LZMAError, zlib.error):
            return None

    return contents.map(one)


def content_hash(files: DataFrame) -> DataFrame:
    """`files` (content) with `sha256` of the decompressed content: built in where nothing is compressed, NULL without content."""
    packed = C.compression(F.col("content")).isNotNull()
    plain = files.where(~F.coalesce(packed, F.lit(False))).withColumn("sha256", F.sha2("content", 256))
    return plain.unionByName(files.where(packed).withColumn("sha256", packed_sha256("content")))


def timed_lines(logs: DataFrame, split_bytes: int = S.SPLIT_BYTES) -> DataFrame:
    """file_id, block_start, mid, raw, error of logs (file_id, path, size, content)."""
    return S.file_lines(logs, split_bytes).join(logs.select("file_id", "path"), "path").drop("path")


def analyse(files: DataFrame, overrides: DataFrame | None = None, version: str = VERSION, split_bytes: int = S.SPLIT_BYTES) -> DataFrame:
    """Catalog rows of files (file_id, path, root, rel, size, mtime, content); `overrides`: path, override.

    `content` is that of members of archives, NULL for others, which are opened by their path. One pass gives packing, head
    and digest of all; then each category has its own: reports by their first bytes, logs by their lines, other files by all times in
    their content, name and file time. A file that can't be read to its end becomes a row with an error and no times. Results
    don't depend on `split_bytes`.
    """
    spark = files.sparkSession
    given = overrides.select("path", "override") if overrides is not None else files.select("path").limit(0).withColumn("override", F.lit(None).cast("string"))
    base = S.examined(files, split_bytes).drop("content").join(given, "path", "left").withColumn("name", F.element_at(F.split("rel", "/"), -1)).withColumn("sniff", C.latin(F.col("head")))
    base = base.withColumn("detected", C.classify(F.col("name"), F.col("sniff"))).withColumn("category", C.effective_category(F.col("override"), F.col("detected")))
    base = base.withColumn("kind", C.content_kind(F.col("head"), F.col("name"))).withColumn("report_type", C.report_type(F.col("sniff"))).drop("sniff", "head")
    facts = written(base.withColumnRenamed("digest", "sha256").withColumn("version", F.lit(version)))
    common = ["file_id", "path", "root", "rel", "size", "mtime", "detected", "override", "category", "sha256", "version"]

    def of(rows: DataFrame, *columns: str) -> DataFrame:
        """Files of some facts, to be read."""
        return files.select("file_id", "path", "size", "content").join(rows.select("path", "packing", *columns), "path")

    reports = facts.where("category = 'awr'")
    reports = reports.join(S.heads(of(reports), C.REPORT_BYTES), "path").withColumn("text", C.report_text(F.col("head").cast("string")))
    reports = parse_reports(reports.select(*common, "report_type", "text")).withColumnsRenamed({"begin": "first_ts", "end": "last_ts"}).drop("text")
    reports = reports.withColumn("error", K.scan_errors(F.col("category"), F.lit(0), F.lit(0), F.col("first_ts"), F.col("last_ts")))

    logs = facts.where(F.col("category").isin(*C.LOGS))
    read = written(timed_lines(of(logs), split_bytes))  # lines of logs only, once for errors, heads and whole lines
    damaged = written(read.where("error is not null").groupBy("file_id").agg(F.max("error").alias("damage")))
    sound = read.where("error is null").drop("error").join(damaged, "file_id", "left_anti")
    timed = written(L.analysed(sound, "file_id"))
    stats = L.log_stats(timed, "file_id").join(timed.select("file_id", "ts_mode").distinct(), "file_id")
    logs = logs.select(*common).join(stats, "file_id", "left").join(damaged, "file_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))
    logs = logs.withColumn("error", F.coalesce("damage", K.scan_errors(F.col("category"), F.col("lines"), F.col("stamped_lines"), F.lit(None), F.lit(None))))

    unknown = facts.where("category = 'unknown'")
    others = of(unknown, "kind", "name")
    text = S.file_lines(others.where("kind = 'text'"), split_bytes).select("path", "raw", "error")
    binary = written(S.binary_parts(others.where("kind = 'binary'")))
    strings = binary.select("path", F.explode_outer(packed.binary_strings(F.col("content"))).alias("raw"), "error").where("raw is not null or error is not null")
    rows = text.unionByName(strings)
    for kind, lines in (("office", packed.office_lines), ("pdf", packed.pdf_lines)):
        rows = rows.unionByName(lines(S.with_content(others.where(F.col("kind") == kind))))
    points = written(intervals.content_points(rows.where("error is null")).withColumn("error", F.lit(None).cast("string")).unionByName(rows.where("error is not null").select("path", F.lit(None).cast("timestamp_ntz").alias("b"), F.lit(None).cast("timestamp_ntz").alias("e"), "error")))
    found = intervals.content_stats(points.where("error is null").drop("error")).select("path", "intervals", F.col("stamps").alias("stamp_count"))
    broken = points.where("error is not null").groupBy("path").agg(F.max("error").alias("broken"))
    others = unknown.select(*common, "kind", "name").join(found, "path", "left").join(broken, "path", "left")
    others = others.withColumn("read_as", F.when(F.col("broken").isNull(), F.col("kind")).otherwise(F.concat("kind", F.lit(" (unreadable: "), "broken", F.lit(")"))))
    others = others.withColumn("named", T.from_name(F.col("name"))).withColumn("mtime_ts", T.trusted_mtime(F.col("mtime")))
    others = K.other_file_range(others)
    own = F.when(F.size("intervals") > 0, F.array_sort(F.array_distinct(F.flatten(F.transform("intervals", lambda i: T.days_between(i["b"], i["e"])))))).otherwise(T.days_between(F.col("first_ts"), F.col("last_ts")))
    others = others.select(*common, "first_ts", "last_ts", own.alias("days"), "date_source", "stamp_count", "read_as", "intervals", "check")
    ignored = facts.where("category = 'ignore'").select(*common)
    out = reports.unionByName(logs, True).unionByName(others, True).unionByName(ignored, True)
    fields = K.empty_catalog(spark).schema.fields
    return out.select(*[f.name for f in fields]).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields])


def affected_windows(plan: Plan, changed: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned windows that have no package yet, or whose window or log days hold a changed day."""
    days = changed.select(F.col("day").cast("timestamp_ntz").alias("b"), (F.date_add("day", 1).cast("timestamp_ntz") - F.expr("interval 1 second")).alias("e")).distinct()
    ranges = plan.windows.select("package", "start_ts", "end_ts").unionByName(plan.windows.select("package", F.col("log_start").alias("start_ts"), F.col("log_end").alias("end_ts")))
    touched = assign.overlapping(days, "b", "e", ranges, "start_ts", "end_ts").select("package")
    missing = plan.windows.join(existing.select("package"), "package", "left_anti").select("package")
    return plan.windows.join(touched.unionByName(missing).distinct(), "package", "left_semi")


def stale_packages(existing: DataFrame, planned: DataFrame, rechecked: DataFrame, built: DataFrame, pattern: str) -> DataFrame:
    """Packages of a name pattern that no window gives any more, or that were built again without a result."""
    valid = built.select("package").unionByName(planned.select("package").join(rechecked.select("package"), "package", "left_anti"))
    return existing.where(F.col("package").rlike(pattern)).join(valid, "package", "left_anti")


def package_pattern(prefix: str, mode: str) -> str:
    """Names of packages of one mode."""
    import re

    tail = r"_\d{4}-\d{2}-\d{2}" + ("" if mode == "day" else r"_\d{4}-(\d{4}|\d{4}-\d{2}-\d{2}_\d{4})")
    return f"^{re.escape(prefix)}{tail}$"


def missing_day_packages(catalog: DataFrame, existing: DataFrame, prefix: str) -> DataFrame:
    """Days with data that have no package."""
    have = existing.select(F.regexp_extract("package", f"^{prefix}_([0-9-]{{10}})$", 1).try_cast("date").alias("day"))
    return K.data_days(catalog).join(have, "day", "left_anti")
