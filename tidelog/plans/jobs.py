"""The jobs that keep a collection of files and its packages current: scan, repackage, reanalyse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.content import LOGS
from tidelog.operators import assign
from tidelog.operators import catalog as K
from tidelog.operators import lines as L
from tidelog.plans import packages, refresh
from tidelog.plans.windows import Plan, plan_windows
from tidelog.sources import files as S
from tidelog.sources import packed
from tidelog.tables import written

PARTS = ("lines", "manifest", "files")
MEMBERS = "archive string, size long, mtime timestamp, member string, content binary, member_mtime timestamp_ntz, error string, skipped boolean"


@dataclass(frozen=True)
class Collection:
    """Where files come from (label: folder), where the catalog and expanded archives are kept, where packages go, and the rules."""

    roots: dict[str, str]
    store: str
    output: str
    prefix: str = "PKG"
    margin_min: int = 0
    require_awr: bool = True
    require_logs: bool = True
    log_scope: str = "snap"
    day_packages: bool = False
    other_max_bytes: int = 0
    skip: tuple[str, ...] = packed.SKIPPED
    split_bytes: int = S.SPLIT_BYTES


@dataclass
class Scan:
    catalog: DataFrame
    changed_days: DataFrame
    stats: dict


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder. Of versions and packages, never of input files."""
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _versioned(spark: SparkSession, path: str) -> str | None:
    """The newest complete version of a table below `path`."""
    done = [n for n in _children(spark, path) if n.startswith("v=") and "_SUCCESS" in _children(spark, f"{path}/{n}")]
    return f"{path}/{max(done, key=lambda n: int(n[2:]))}" if done else None


def _new_version(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """`df` as the next version of a table; older ones but the last go. A job that dies in between leaves the last one valid."""
    numbers = [int(n[2:]) for n in _children(spark, path) if n.startswith("v=")]
    target = f"{path}/v={max(numbers, default=0) + 1}"
    df.write.parquet(target)
    for n in sorted(numbers)[:-1]:
        fs, at = _folder(spark, f"{path}/v={n}")
        fs.delete(at, True)
    return spark.read.schema(df.schema).parquet(target)


def catalog(spark: SparkSession, of: Collection) -> DataFrame:
    """The known files, empty before the first scan."""
    path = _versioned(spark, f"{of.store}/catalog")
    return spark.read.schema(K.empty_catalog(spark).schema).parquet(path) if path else K.empty_catalog(spark)


def expanded(spark: SparkSession, of: Collection, archives: DataFrame) -> DataFrame:
    """Members of all archives of a listing; only new and changed archives are opened, the others' members are kept."""
    path = _versioned(spark, f"{of.store}/members")
    old = spark.read.schema(MEMBERS).parquet(path) if path else spark.createDataFrame([], MEMBERS)
    now = archives.select(F.col("path").alias("archive"), "size", "mtime")
    known = old.select("archive", "size", "mtime").distinct()
    fresh = written(now.join(known, ["archive", "size", "mtime"], "left_anti"))
    gone = known.join(now, ["archive", "size", "mtime"], "left_anti")
    if fresh.isEmpty() and gone.isEmpty():
        return old
    opened = packed.expand_archives(S.with_content(fresh.withColumnRenamed("archive", "path")), of.skip).withColumnRenamed("mtime", "member_mtime")
    new = fresh.join(opened, "archive").select("archive", "size", "mtime", "member", "content", "member_mtime", "error", "skipped")
    return _new_version(spark, f"{of.store}/members", old.join(now, ["archive", "size", "mtime"], "left_semi").select(*new.columns).unionByName(new))


def listing(spark: SparkSession, of: Collection) -> tuple[DataFrame, DataFrame]:
    """All files that are to be known, members of archives among them (`inside`, with content), and the members' table."""
    files = written(S.list_files(spark, of.roots))
    is_archive = F.col("path").rlike(packed.ARCHIVES)
    members = expanded(spark, of, files.where(is_archive))
    folder = F.regexp_replace("rel", packed.ARCHIVES, "")
    inside = members.where("content is not null").drop("size", "mtime").join(files.select(F.col("path").alias("archive"), "root", "rel"), "archive").select(
        "root", F.concat_ws("/", "archive", "member").alias("path"), F.octet_length("content").cast("long").alias("size"), F.col("member_mtime").cast("timestamp").alias("mtime"),
        F.concat_ws("/", folder, "member").alias("rel"), F.lit(True).alias("inside"), "content",
    )
    plain = files.where(~is_archive).withColumns({"inside": F.lit(False), "content": F.lit(None).cast("binary")})
    return plain.select(*inside.columns).unionByName(inside), members


def scan(spark: SparkSession, of: Collection) -> Scan:
    """List all files, analyse new and changed ones, store the catalog; the days that this touches.

    A file is changed by its size, its time or the version of the analysis. Overrides set by hand survive. Archives that
    can't be expanded are reported in the stats; a file that can't be read is a row of the catalog with an error.
    """
    old = catalog(spark, of)
    found, members = listing(spark, of)
    diff = written(K.catalog_diff(found, old, refresh.VERSION))
    todo = found.join(diff.where("status in ('new', 'changed')"), "path", "left_semi").withColumn("file_id", F.xxhash64("path"))
    fresh = written(refresh.analyse(todo, old.where("override is not null").select("path", "override"), split_bytes=of.split_bytes))
    new, days = _recorded(spark, of, old, K.upsert_catalog(fresh, old, diff.where("status = 'removed'")), diff)
    stats = K.scan_stats(diff, new).first().asDict()
    broken = [f"{r.archive.rsplit('/', 1)[-1]}: {r.error}" for r in members.where("error is not null").select("archive", "error").distinct().orderBy("archive").collect()]
    counts = members.agg(F.count_if(F.col("content").isNotNull()), F.count_if("skipped")).first()
    stats |= {"members": counts[0], "skipped_members": counts[1], "archive_errors": broken}
    return Scan(new, days, stats)


def set_category(spark: SparkSession, of: Collection, path: str, category: str | None) -> Scan:
    """Give a file a category by hand, or take it back with None, and analyse it again as what it now is."""
    old = catalog(spark, of)
    row = old.where(F.col("path") == path).select("file_id").first()
    if row is None:
        raise ValueError(f"unknown file: {path}")
    marked = written(K.set_override(old, row.file_id, category))
    found, _ = listing(spark, of)
    todo = found.where(F.col("path") == path).withColumn("file_id", F.xxhash64("path"))
    fresh = written(refresh.analyse(todo, marked.where("override is not null").select("path", "override"), split_bytes=of.split_bytes))
    new, days = _recorded(spark, of, old, K.upsert_catalog(fresh, marked), spark.createDataFrame([(path, "changed")], "path string, status string"))
    return Scan(new, days, {"new": 1})


# ---- pending days: what the catalog has changed and no package shows yet


def _recorded(spark: SparkSession, of: Collection, old: DataFrame, rows: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store `rows` as the next catalog, and before that the days that it touches in the journal.

    A job that dies between the two leaves days too many, never too few.
    """
    new = written(rows)
    days = _appended(spark, f"{of.store}/journal", K.changed_days(old, new, diff))
    return _new_version(spark, f"{of.store}/catalog", new), days


def _appended(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """`df` as a further entry of a journal."""
    target = f"{path}/v={max([int(n[2:]) for n in _children(spark, path) if n.startswith('v=')], default=0) + 1}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def _entries(spark: SparkSession, of: Collection) -> list[str]:
    """Complete entries of the journal."""
    path = f"{of.store}/journal"
    return [f"{path}/{n}" for n in _children(spark, path) if n.startswith("v=") and "_SUCCESS" in _children(spark, f"{path}/{n}")]


def pending_days(spark: SparkSession, of: Collection) -> DataFrame:
    """Days of all changes that no repackaging has finished yet."""
    entries = _entries(spark, of)
    return spark.read.schema("day date").parquet(*entries).distinct() if entries else spark.createDataFrame([], "day date")


# ---- published packages


def current(spark: SparkSession, of: Collection) -> DataFrame:
    """(package, build): the packages that readers see, and the build that wrote each."""
    path = _versioned(spark, f"{of.output}/current")
    return spark.read.schema("package string, build int").parquet(path) if path else spark.createDataFrame([], "package string, build int")


def existing_packages(spark: SparkSession, of: Collection) -> DataFrame:
    """Packages that are published."""
    return current(spark, of).select("package")


def published(spark: SparkSession, of: Collection, part: str) -> DataFrame:
    """`lines`, `manifest` or `files` of all published packages, with package and entry: of each package one build, whole."""
    path = f"{of.output}/{part}"
    if not _children(spark, path):
        return spark.createDataFrame([], "package string, value string")
    rows = spark.read.parquet(path) if part == "files" else spark.read.option("lineSep", "\n").text(path)
    if part != "files":  # part files are in the order of their lines
        rows = rows.withColumn("part_file", F.col("_metadata.file_name"))
    return rows.join(F.broadcast(current(spark, of)), ["package", "build"], "left_semi").drop("build")  # a row a package


def publish(spark: SparkSession, of: Collection, rows: DataFrame) -> None:
    """Make `rows` (package, build) what readers see, in one step, and then delete what neither they nor the version before need.

    A job that dies before leaves the old packages as they were; one that dies after leaves files that nobody reads.
    """
    path = f"{of.output}/current"
    versions = sorted((n for n in _children(spark, path) if n.startswith("v=") and "_SUCCESS" in _children(spark, f"{path}/{n}")), key=lambda n: int(n[2:]))
    load = lambda n: spark.read.schema("package string, build int").parquet(f"{path}/{n}")
    before = [written(load(n)) for n in versions[-2:]]
    new = _new_version(spark, path, rows.select("package", "build"))
    live = written(new.unionByName(before[-1]).distinct()) if before else new
    dead = before[0].join(live, ["package", "build"], "left_anti").toLocalIterator() if len(before) > 1 else []  # names of packages
    _deleted(spark, [f"{of.output}/{part}/build={r.build}/package={r.package}" for r in dead for part in PARTS])
    builds = {r.build for r in live.select("build").distinct().toLocalIterator()}
    _deleted(spark, [f"{of.output}/{part}/build={n}" for part in PARTS for n in _builds(spark, of, part) if n not in builds])


def _builds(spark: SparkSession, of: Collection, part: str) -> list[int]:
    return [int(n[6:]) for n in _children(spark, f"{of.output}/{part}") if n.startswith("build=")]


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = _folder(spark, path)
        fs.delete(at, True)


def remove_packages(spark: SparkSession, of: Collection, gone: DataFrame) -> int:
    """Take packages out of what is published."""
    gone = written(gone.select("package").distinct())
    n = gone.count()
    if n:
        publish(spark, of, current(spark, of).join(gone, "package", "left_anti"))
    return n


def build(spark: SparkSession, of: Collection, known: DataFrame, plan: Plan) -> DataFrame:
    """Write the packages of a plan as a new build and return (package, build); nothing is published yet.

    Only logs near its windows are read, with what `known` says of them.
    """
    near = packages.by_windows(known.where(F.col("category").isin(*LOGS) & F.col("first_ts").isNotNull()), plan.windows).select("path", "file_id", "ts_mode")
    found, _ = listing(spark, of)
    whole = plan.reports.select("file_id").unionByName(plan.files.select("file_id")).distinct()
    wanted = written(found.withColumn("file_id", F.xxhash64("path")).join(near.select("file_id").unionByName(whole).distinct(), "file_id", "left_semi"))
    lines = refresh.timed_lines(wanted.join(near.select("path"), "path", "left_semi"), of.split_bytes).where("error is null").drop("error")
    lines = written(lines.join(near.select("file_id", "ts_mode"), "file_id"))
    anywhere = lines.where("ts_mode = 'ganze Zeile'")
    timed = L.stamped(lines.where("ts_mode <> 'ganze Zeile'").drop("ts_mode"), "file_id").drop("pattern").unionByName(L.stamped_whole(anywhere.drop("ts_mode")))
    built = packages.build_packages(known, timed, plan, of.require_logs, of.other_max_bytes)
    number = max([n for part in PARTS for n in _builds(spark, of, part)], default=0) + 1
    if not built.windows.isEmpty():
        copied = wanted.join(whole, "file_id", "left_semi").select("file_id", "path", "content")
        packages.write_packages(built, of.output, S.parts(copied).join(copied.select("file_id", "path"), "path"), number)
    return built.windows.select("package", F.lit(number).alias("build"))


def part_of(plan: Plan, windows: DataFrame) -> Plan:
    """The plan of some of its windows."""
    windows = written(windows)
    return Plan(windows, *(t.join(windows, "package", "left_semi") for t in (plan.reports, plan.files)))


def repackage(spark: SparkSession, of: Collection, changed: DataFrame | None = None) -> dict:
    """Build what pending (and `changed`) days touch, and remove packages that no rule gives any more.

    First the windows of reports: those without a package and those on touched days; then, if `day_packages` is on, the
    days; if it is off, day packages that don't meet the rules go and others stay. The days are cleared from the journal at the end: a
    job that fails in between is made up for by the next one.
    """
    known, out, entries = catalog(spark, of), {}, _entries(spark, of)
    days = pending_days(spark, of)
    changed = written(days if changed is None else days.unionByName(changed.select("day")).distinct())
    existing = written(existing_packages(spark, of))
    plan = plan_windows(known, "awr", of.prefix, of.margin_min, require_awr=of.require_awr, log_scope=of.log_scope)
    todo = part_of(plan, refresh.affected_windows(plan, changed, existing))
    out["built"], out["removed"] = _rebuilt(spark, of, known, plan, todo, "awr")
    days = plan_windows(known, "day", of.prefix, require_awr=of.require_awr)
    if of.day_packages:
        missing = refresh.missing_day_packages(known, existing, of.prefix)
        touched = days.windows.join(changed.select("day").unionByName(missing).distinct(), F.to_date("start_ts") == F.col("day"), "left_semi")
        out["built_days"], out["removed_days"] = _rebuilt(spark, of, known, days, part_of(days, touched), "day")
    else:
        valid = days.windows
        if of.require_logs:
            valid = assign.has_log_candidates(valid, known.where(F.col("category").isin(*LOGS) & F.col("first_ts").isNotNull()))
        none = days.windows.limit(0)
        out["removed_days"] = remove_packages(spark, of, refresh.stale_packages(existing_packages(spark, of), valid, none, none, refresh.package_pattern(of.prefix, "day")))
    _deleted(spark, entries)
    return out


def _rebuilt(spark: SparkSession, of: Collection, known: DataFrame, plan: Plan, todo: Plan, mode: str) -> tuple[int, int]:
    """Write the packages of `todo`, then publish them and take out stale ones in the same step."""
    before = written(current(spark, of))
    built = before.limit(0) if todo.windows.isEmpty() else written(build(spark, of, known, todo))
    stale = written(refresh.stale_packages(before.select("package"), plan.windows, todo.windows, built, refresh.package_pattern(of.prefix, mode)))
    n, gone = built.count(), stale.count()
    if n or gone:
        kept = before.join(built.select("package").unionByName(stale.select("package")), "package", "left_anti")
        publish(spark, of, kept.unionByName(built.select("package", "build")))
    return n, gone


def build_days(spark: SparkSession, of: Collection, mode: str = "day") -> dict:
    """Build all packages of a mode by hand, whatever changed."""
    known = catalog(spark, of)
    plan = plan_windows(known, mode, of.prefix, of.margin_min if mode == "awr" else 0, require_awr=of.require_awr, log_scope=of.log_scope)
    built = written(build(spark, of, known, plan)) if not plan.windows.isEmpty() else current(spark, of).limit(0)
    if not built.isEmpty():
        publish(spark, of, current(spark, of).join(built, "package", "left_anti").unionByName(built))
    return {"built": built.count()}


def refreshed(spark: SparkSession, of: Collection) -> dict:
    """Scan, then repackage what changed now or was left over: everything after files have come, changed or gone. May be run again at any time."""
    found = scan(spark, of)
    return found.stats | repackage(spark, of)
