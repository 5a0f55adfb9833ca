"""Files of any size as rows: listings, what each holds, and lines with their place.

Files are opened inside tasks by pyarrow's file systems (local, hdfs, s3, gs, abfss and others by the path's scheme), so
names stay rows of a table and nothing has to fit into one row. Plain files are read in ranges by many tasks, compressed
ones as streams.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.functions.content import SNIFF_BYTES

#: Bytes of a plain file that one task reads as lines; of decompressed content that are handled at once; and of a block that
#: has a digest of its own.
SPLIT_BYTES, CHUNK_BYTES, BLOCK_BYTES = 64 * 1024 * 1024, 8 * 1024 * 1024, 4 * 1024 * 1024
#: Bytes of a binary file in which text is sought; of a file that is taken as one row (archives, office documents, PDFs).
BINARY_BYTES, ROW_BYTES = 256 * 1024 * 1024, 2**31 - 1
#: Folders among which a listing is dealt out, at least, if there are as many.
LISTING_FOLDERS = 64
DAMAGED = (OSError, EOFError, lzma.LZMAError, zlib.error)
LISTING = "root string, path string, size long, mtime timestamp, rel string"


def root_labels(dirs: Iterable[str], inbox: str | None = None) -> dict[str, str]:
    """A label for each source folder: its name, with `_` behind it until it is unused; the inbox comes first."""
    out = {"inbox": inbox} if inbox else {}
    for d in dirs:
        label = d.rstrip("/").rsplit("/", 1)[-1] or "source"
        while label in out:
            label += "_"
        out[label] = d
    return out


# ---- opening


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its name there. A path without a scheme is local; nothing in a name is a pattern."""
    scheme, found, rest = path.partition("://")
    if not found or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if found else re.sub("^file:", "", path)).lstrip("/")
    authority, _, inner = rest.partition("/")
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def packing_of(head: bytes) -> str | None:
    """gz, bz2, xz or None by the first bytes, whatever the file is called."""
    return "gz" if head[:2] == b"\x1f\x8b" else "bz2" if head[:3] == b"BZh" else "xz" if head[:6] == b"\xfd7zXZ\x00" else None


def raw_stream(path: str, content: bytes | None):
    """A stream of a file's bytes as they are; of `content` if that is given."""
    if content is not None:
        return pa.BufferReader(content)
    system, name = located(path)
    return system.open_input_file(name)


def stream_of(path: str, content: bytes | None = None):
    """A stream of a file's bytes, decompressed, and how it was packed."""
    raw = raw_stream(path, content)
    packing = packing_of(raw.read(6))
    raw.seek(0)
    opener = {"gz": lambda: gzip.GzipFile(fileobj=raw), "bz2": lambda: bz2.BZ2File(raw), "xz": lambda: lzma.LZMAFile(raw)}.get(packing, lambda: raw)
    return opener(), packing


def chunks_of(stream, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Pieces of `size` bytes of a stream; only the last may be shorter."""
    while True:
        parts, left = [], size
        while left and (piece := stream.read(left)):
            parts.append(piece)
            left -= len(piece)
        if parts:
            yield b"".join(parts)
        if left:
            return


# ---- listing


class _Folder(InputPartition):
    def __init__(self, label: str, root: str, folders: list[str], names: list[str]):
        self.label, self.root, self.folders, self.names = label, root, folders, names


class _Lister(DataSourceReader):
    """Files below the roots, a few folders a task; paths with a part that starts with `.` are left out."""

    def __init__(self, roots: dict[str, str]):
        self.roots = roots

    def partitions(self) -> list[_Folder]:
        out = []
        for label, root in self.roots.items():
            system, base = located(root.rstrip("/"))
            level, names = [base], []
            while level and len(level) < LISTING_FOLDERS:  # folder by folder, until there are enough to deal out
                found = [i for folder in level for i in system.get_file_info(pafs.FileSelector(folder)) if not i.base_name.startswith(".")]
                names += [i.path for i in found if i.type == pafs.FileType.File]
                level = [i.path for i in found if i.type == pafs.FileType.Directory]
            out += [_Folder(label, root, [folder], []) for folder in level]
            out += [_Folder(label, root, [], names[a : a + 1000]) for a in range(0, len(names), 1000)]
        return out or [_Folder("", "", [], [])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.root:
            return
        root = partition.root.rstrip("/")
        system, base = located(root)
        folders = list(partition.folders)
        batches = [system.get_file_info(partition.names)] if partition.names else []
        while batches or folders:
            for i in batches.pop() if batches else system.get_file_info(pafs.FileSelector(folders.pop())):
                if i.base_name.startswith("."):
                    continue
                if i.type == pafs.FileType.Directory:
                    folders.append(i.path)
                elif i.type == pafs.FileType.File:
                    rel = i.path[len(base) :].lstrip("/")
                    yield partition.label, f"{root}/{rel}", i.size, i.mtime, rel


class FileListing(DataSource):
    """Spark data source `tidelog_files`; option `roots`: JSON of labels and folders."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Lister(json.loads(self.options["roots"]))


def list_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """root, rel, path, size, mtime of all files below the roots, names that start with `_` too; paths with a part that starts with `.` go. Contents aren't read."""
    spark.dataSource.register(FileListing)
    return spark.read.format("tidelog_files").option("roots", json.dumps(roots)).load()


# ---- contents


def _dealt(files: DataFrame, *by: str) -> DataFrame:
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _with(files: DataFrame, **columns: str) -> DataFrame:
    """`files` with null columns where it lacks them."""
    return files.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in files.columns})


def ranges(files: DataFrame, split_bytes: int, known: bool) -> DataFrame:
    """(path, content, start, end): plain files in ranges, others as a whole (end is NULL).

    `known`: `files` has `packing`. If not, the first bytes of files of more than `split_bytes` are looked at.
    """
    files = _with(files, content="binary")
    if not known:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for path in batch.column("path").to_pylist():
                    try:
                        found.append(stream_of(path)[1] or "plain")
                    except DAMAGED:
                        found.append("damaged")
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "packing"])

        large = files.where((F.col("size") > split_bytes) & F.col("content").isNull()).select("path")
        files = files.join(_dealt(large, "path").mapInArrow(run, "path string, packing string"), "path", "left")
        plain = F.col("packing") == "plain"
    else:
        plain = F.col("packing").isNull() & F.col("content").isNull()
    split = F.when(plain & (F.col("size") > split_bytes), F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")), lambda a: F.struct(a.alias("start"), F.least(a + split_bytes, F.col("size")).alias("end"))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))
    return files.select("path", "content", F.explode(F.coalesce(split, whole)).alias("r")).select("path", "content", "r.start", "r.end")


def _range_lines(path: str, content: bytes | None, start: int, end: int | None) -> Iterator[list[bytes]]:
    """Lists of lines without their ends: those that begin in the range, the last one to its end."""
    if end is None:
        stream = stream_of(path, content)[0]
    else:
        stream = raw_stream(path, content)
        if start:
            stream.seek(start - 1)
    rest, at = [], start - 1 if start and end is not None else 0
    skip = bool(start) and end is not None  # up to the first line end, which may be just before the range
    for chunk in chunks_of(stream, CHUNK_BYTES if end is None else min(CHUNK_BYTES, max(4096, end - start + 1))):
        if skip:
            cut = chunk.find(b"\n")
            if cut < 0:
                at += len(chunk)
                continue
            chunk, skip = chunk[cut + 1 :], False
            at += cut + 1
        if end is not None and not rest and at >= end:
            return
        parts = chunk.split(b"\n")
        if len(parts) == 1:
            rest.append(chunk)
            at += len(chunk)
            continue
        lines = [b"".join([*rest, parts[0]]), *parts[1:-1]]
        if end is not None and at + len(chunk) >= end:  # lines that begin at `end` or behind it are the next range's
            begin, own = at - sum(map(len, rest)), 0
            for line in lines:
                if begin >= end:
                    break
                begin, own = begin + len(line) + 1, own + 1
            if own < len(lines) or begin >= end:
                yield lines[:own]
                return
        at += len(chunk)
        rest = [parts[-1]]
        yield lines
        if not rest[0]:
            rest = []
    if rest and (end is None or at - sum(map(len, rest)) < end):
        yield [b"".join(rest)]


def file_lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, block_start, mid, raw, error of files (path, size; content of those that are members of archives; packing, if known).

    Bytes are kept; lines end at \\n only. Plain files are read in ranges of `split_bytes`, compressed ones as a stream, gz,
    bz2 and xz by their first bytes. (path, block_start, mid) is the order of a file. A file that can't be read to its end has a row with
    an error and no line behind those that could be read. However the ranges lie the lines are the same.
    """

    def rows(path: str, start: int, at: int, lines: list, error: str | None) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.binary()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "block_start", "mid", "raw", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, start, end in zip(*(batch.column(k) for k in range(4)), strict=True):
                path, start, at = path.as_py(), start.as_py(), 0
                try:
                    for lines in _range_lines(path, content.as_py(), start, end.as_py()):
                        if lines:
                            yield rows(path, start, at, lines, None)
                        at += len(lines)
                except DAMAGED as e:
                    yield rows(path, start, at, [None], f"{type(e).__name__}: {e}")

    split = _dealt(ranges(files, split_bytes, "packing" in files.columns), "path", "start")
    read = split.mapInArrow(run, "path string, block_start long, mid long, raw binary, error string")
    return read.withColumn("raw", F.col("raw").cast("string"))


def examined(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`files` (path, size, content) with packing, head (first SNIFF_BYTES, decompressed), digest and error, each read once.

    The digest is SHA-256 of the decompressed bytes up to BLOCK_BYTES, and of more SHA-256 over the digests of their blocks: the same
    for a plain file that many tasks read, a compressed one and a member of an archive. It is NULL for a file that can't be
    read to its end.
    """
    step = max(1, split_bytes // BLOCK_BYTES) * BLOCK_BYTES
    kind = "path string, block long, head binary, packing string, digest binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, packing, block = [], None, start // BLOCK_BYTES
                try:
                    if end is None:
                        stream, packing = stream_of(path, content)
                        blocks = chunks_of(stream, BLOCK_BYTES)
                    else:
                        stream = raw_stream(path, content)
                        stream.seek(start)
                        blocks = (stream.read(min(BLOCK_BYTES, end - a)) for a in range(start, end, BLOCK_BYTES))
                    for body in blocks:
                        out.append((path, block, body[:SNIFF_BYTES] if block == 0 else None, packing, hashlib.sha256(body).digest(), None))
                        block += 1
                    if end is None and not out:
                        out.append((path, 0, b"", packing, hashlib.sha256(b"").digest(), None))
                except DAMAGED as e:
                    out.append((path, block, b"" if block == 0 else None, packing, None, f"{type(e).__name__}: {e}"))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "block", "head", "packing", "digest", "error"])

    types = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string()]
    files = _with(files, content="binary")
    parts = _dealt(ranges(files, step, False), "path", "start").mapInArrow(run, kind)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])  # 32 bytes for 4 MiB
    found = parts.groupBy("path").agg(F.max("head").alias("head"), F.max("packing").alias("packing"), F.max("error").alias("read_error"), F.count(F.lit(1)).alias("n"), blocks.alias("blocks"))
    whole = F.aggregate("blocks", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x))
    digest = F.when(F.col("read_error").isNull(), F.when(F.col("n") == 1, F.lower(F.hex(F.col("blocks")[0]))).otherwise(F.sha2(whole, 256)))
    return files.join(found.select("path", "head", "packing", digest.alias("digest"), "read_error"), "path", "left")


def heads(files: DataFrame, size: int) -> DataFrame:
    """(path, head): the first `size` bytes of files (path, content), decompressed; empty if unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    head = next(chunks_of(stream_of(path, content.as_py())[0], size), b"")
                except DAMAGED:
                    head = b""
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([head], pa.binary())], ["path", "head"])

    return _dealt(_with(files, content="binary").select("path", "content"), "path").mapInArrow(run, "path string, head binary")


def parts(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(path, part, content): the bytes of files as they are, in numbered pieces; a file that can't be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    for n, body in enumerate(chunks_of(raw_stream(path, content.as_py()), size)):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int32()), pa.array([body], pa.binary())], ["path", "part", "content"])
                except DAMAGED:
                    continue

    return _dealt(_with(files, content="binary").select("path", "content"), "path").mapInArrow(run, "path string, part int, content binary")


def binary_parts(files: DataFrame, most: int = BINARY_BYTES, size: int = CHUNK_BYTES) -> DataFrame:
    """(path, content): the first `most` decompressed bytes of files in pieces that no printable run is cut by; and `error`."""
    unprintable = re.compile(rb"[^\x20-\x7e\xc0-\xff]")

    def row(path: str, body: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([body], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rest, left = b"", most
                try:
                    for body in chunks_of(stream_of(path, content.as_py())[0], min(size, most)):
                        body = rest + body[:left]
                        left -= len(body) - len(rest)
                        cut = max((m.start() for m in unprintable.finditer(body, max(0, len(body) - 65_536))), default=len(body))  # a longer run is cut
                        yield row(path, body[:cut], None)
                        rest = body[cut:]
                        if left <= 0:
                            break
                    if rest:
                        yield row(path, rest, None)
                except DAMAGED as e:
                    yield row(path, None, f"{type(e).__name__}: {e}")

    return _dealt(_with(files, content="binary").select("path", "content"), "path").mapInArrow(run, "path string, content binary, error string")


def with_content(files: DataFrame, most: int = ROW_BYTES) -> DataFrame:
    """`files` with `content` as one row each, NULL for files of more than `most` bytes and those that can't be read."""
    files = _with(files, content="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    body = b"".join(chunks_of(raw_stream(path, None)))
                except DAMAGED:
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([body], pa.large_binary()).cast(pa.binary())], ["path", "read"])

    small = files.where(F.col("content").isNull() & (F.col("size") <= most)).select("path")
    read = _dealt(small, "path").mapInArrow(run, "path string, read binary")
    return files.join(read, "path", "left").withColumn("content", F.coalesce("content", "read")).drop("read")


def with_final_newline(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """path, ends_with_newline of uncompressed files, from the lines' lengths and the files' sizes (path, size)."""
    total = lines.groupBy("path").agg(F.sum(F.octet_length("raw") + 1).alias("bytes"))
    return total.join(sizes.select("path", "size"), "path").select("path", (F.col("bytes") == F.col("size")).alias("ends_with_newline"))
