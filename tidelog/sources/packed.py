"""Contents inside archives, office documents, PDFs and other binary files."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.content import JAVA_ARCHIVES

ARCHIVES = r"(?i)\.(zip|tar|tar\.gz|tgz)$"
SKIPPED = JAVA_ARCHIVES
OFFICE_PART_BYTES = 512 * 1024 * 1024
MEMBER_SCHEMA = "archive string, member string, mtime timestamp_ntz, content binary, skipped boolean, error string"


def _escapes(name: str) -> bool:
    return posixpath.isabs(name) or posixpath.normpath(name).split("/")[0] == ".."


def _members(path: str, content: bytes, skip: tuple[str, ...]) -> Iterator[tuple]:
    """(member, mtime, reader) of an archive; raises on broken ones and on members that leave the target folder."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if bad := [i.filename for i in infos if not i.filename.lower().endswith(skip) and _escapes(i.filename)]:
                raise ValueError(f"path leaves the archive: {bad[0]}")
            for i in infos:
                stamp = datetime(*i.date_time) if 1 <= i.date_time[1] <= 12 and i.date_time[2] else None
                yield i.filename, stamp, None if i.filename.lower().endswith(skip) else z.read(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            infos = [m for m in t.getmembers() if m.isfile()]
            if bad := [m.name for m in infos if not m.name.lower().endswith(skip) and _escapes(m.name)]:
                raise ValueError(f"path leaves the archive: {bad[0]}")
            for m in infos:
                yield m.name, datetime.fromtimestamp(m.mtime, UTC).replace(tzinfo=None) if m.mtime else None, None if m.name.lower().endswith(skip) else t.extractfile(m).read()


def expand_archives(files: DataFrame, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Members of zip and tar files (path, content): archive, member, mtime, content, skipped, error.

    Members with a suffix of `skip` have no content. A broken archive, or one with a member that would leave its folder, is
    one row with an error and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, name, stamp, body, body is None, None) for name, stamp, body in _members(path, content, skip)]
                except Exception as e:  # a broken file is a row, never the end of the job
                    rows = [(path, None, None, None, False, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["archive", "member", "mtime", "content", "skipped", "error"])
                out["mtime"] = pd.to_datetime(out["mtime"])
                yield out

    return files.where(F.col("path").rlike(ARCHIVES)).select("path", "content").mapInPandas(run, MEMBER_SCHEMA)


def archive_counts(members: DataFrame) -> DataFrame:
    """archive, expanded, skipped, error of each archive."""
    return members.groupBy("archive").agg(F.count_if(F.col("content").isNotNull()).alias("expanded"), F.count_if(F.col("skipped")).alias("skipped"), F.max("error").alias("error"))


def _per_file(files: DataFrame, texts) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, line, None) for text in texts(content) for line in text.splitlines()]
                except Exception as e:
                    rows = [(path, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "raw", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, raw string, error string")


class _Text(HTMLParser):
    """The character data of a markup text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def office_lines(files: DataFrame) -> DataFrame:
    """path, raw, error: the character data of all XML parts of office documents."""

    def texts(content: bytes) -> Iterator[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as document:
            for part in document.namelist():
                if not part.lower().endswith(".xml") or document.getinfo(part).file_size >= OFFICE_PART_BYTES:
                    continue
                reader = _Text()
                with document.open(part) as stream:
                    for piece in io.TextIOWrapper(stream, "utf-8", "replace"):
                        reader.feed(piece)
                reader.close()
                yield " ".join(reader.found)

    return _per_file(files, texts)


#: Parts of PDF syntax (ISO 32000): strings, hexadecimal strings, names, arrays' ends and operators or numbers.
PDF_TOKEN = re.compile(rb"(?P<open>\()|<(?P<hex>[0-9A-Fa-f\s]*)>|/(?P<name>[^\s/()<>\[\]{}%]*)|(?P<mark>[\[\]])|(?P<word>[^\s/()<>\[\]{}%]+)")
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(body: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis lies before `at`, and the place behind its closing one."""
    out, depth = bytearray(), 1
    while at < len(body):
        c = body[at : at + 1]
        at += 1
        if c == b"\\":
            if octal := re.compile(rb"[0-7]{1,3}").match(body, at):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                out += PDF_ESCAPES.get(body[at : at + 1], body[at : at + 1].strip(b"\r\n"))
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def pdf_shown(body: bytes) -> str:
    """The strings that a content stream shows: pieces of one array or operator run on, a new place begins a line."""
    out, at = [], 0
    while found := PDF_TOKEN.search(body, at):
        at = found.end()
        if found["open"]:
            text, at = pdf_string(body, at)
            out.append(text)
        elif found["hex"]:
            digits = b"".join(found["hex"].split())
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif found["word"] in (b"Td", b"TD", b"Tm", b"T*", b"ET", b"'", b'"'):
            out.append(b"\n")
    return b"".join(out).decode("latin-1")


def pdf_dates(body: bytes) -> Iterator[str]:
    """Times of creation and change of a document's information dictionary."""
    for found in PDF_TOKEN.finditer(body):
        if found["name"] in (b"CreationDate", b"ModDate") and (opening := re.compile(rb"\s*\(").match(body, found.end())):
            digits = re.sub(rb"\D.*", b"", pdf_string(body, opening.end())[0].removeprefix(b"D:"), flags=re.S).decode()
            if len(digits) >= 8:
                full = digits.ljust(14, "0")
                yield f"{full[:4]}-{full[4:6]}-{full[6:8]} {full[8:10]}:{full[10:12]}:{full[12:14]}"


def pdf_streams(body: bytes) -> Iterator[bytes]:
    """Bodies of a document's streams, inflated where they are deflated."""
    at = 0
    while (begin := body.find(b"stream", at)) >= 0:
        begin = body.find(b"\n", begin) + 1
        end = body.find(b"endstream", begin)
        if not begin or end < 0:
            return
        try:
            yield zlib.decompressobj().decompress(body[begin:end])
        except zlib.error:
            yield body[begin:end]
        at = end + len(b"endstream")


def pdf_lines(files: DataFrame) -> DataFrame:
    """path, raw, error: times of PDF documents, and what their streams show; a stream that shows no string is given as it is."""

    def texts(content: bytes) -> Iterator[str]:
        yield from pdf_dates(content)
        for body in pdf_streams(content):
            yield pdf_shown(body).strip() or body.decode("latin-1")

    return _per_file(files, texts)


def binary_strings(content: Column) -> Column:
    """Printable runs of six bytes or more."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7e\xc0-\xff]{6,}"), F.lit(0))
