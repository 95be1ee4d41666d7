"""What a file is, by its content, and whether its archive is safe to open."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of archives.
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
MEBIBYTE = 1024 * 1024
STATUS = "path string, format string, code string, message string"


@dataclass(frozen=True)
class Limits:
    """Expanded bytes in all and of a member, members, and how far a member over a million bytes may be compressed."""

    total: int = 750 * MEBIBYTE
    member: int = 200 * MEBIBYTE
    entries: int = 50_000
    ratio: int = 200


class IngestionError(Exception):
    """A file that can't be read as a book; code says why."""

    code = "ingestion"


class CorruptArchiveError(IngestionError):
    code = "corrupt"


class UnsupportedFormatError(IngestionError):
    code = "unsupported"


class UnsafeArchiveError(Exception):
    code = "unsafe_archive"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of the .docx and .epub files below the paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,epub,DOCX,EPUB}").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def describe(content: Column) -> Column:
    """What a file that is no ZIP archive is, from its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    begins = lambda raw: head.startswith(raw.hex().upper())
    return (
        F.when(F.length(content) == 0, "empty")
        .when(begins(b"PK\x03\x04") | begins(b"PK\x05\x06") | begins(b"PK\x07\x08"), "zip")
        .when(begins(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "ole2: a legacy or password-protected document")
        .when(begins(b"%PDF"), "pdf")
        .when(begins(b"{\\rtf"), "rtf")
        .when(begins(b"<?xml") | begins(b"<html") | begins(b"<!DOC"), "html or xml")
        .when(F.substring(content, 1, 8).cast("string").rlike(r"^\s*$"), "blank")
        .otherwise("unknown")
    )


def is_safe_name(name: str) -> bool:
    """Whether a member's name is a relative path that stays inside."""
    if not name or name[0] in "/\\" or ":" in name.partition("/")[0]:
        return False
    path = posixpath.normpath(name.replace("\\", "/"))
    return path != ".." and not path.startswith("../")


def check_members(members: list[zipfile.ZipInfo], limits: Limits = Limits()) -> None:
    if len(members) > limits.entries:
        raise UnsafeArchiveError(f"{len(members)} members, more than {limits.entries}")
    for m in members:
        if not is_safe_name(m.filename):
            raise UnsafeArchiveError(f"member outside the archive: {m.filename!r}")
        if m.file_size > limits.member:
            raise UnsafeArchiveError(f"member of {m.file_size} bytes: {m.filename}")
        if m.file_size > 1_000_000 and m.compress_size and m.file_size / m.compress_size > limits.ratio:
            raise UnsafeArchiveError(f"member compressed too far: {m.filename}")
    if sum(m.file_size for m in members) > limits.total:
        raise UnsafeArchiveError(f"more than {limits.total} bytes expanded")


def sniff(content: bytes, limits: Limits = Limits()) -> str:
    """docx or epub, or an error that says what else."""
    if not content:
        raise CorruptArchiveError("empty")
    if not content.startswith(ZIP_MAGIC):
        raise UnsupportedFormatError("no archive")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            check_members(z.infolist(), limits)
            bad = z.testzip()
            names = set(z.namelist())
    except (zipfile.BadZipFile, EOFError) as e:
        raise CorruptArchiveError("damaged or truncated archive") from e
    if bad is not None:
        raise CorruptArchiveError(f"corrupt member {bad!r}")
    if "word/document.xml" in names:
        return "docx"
    if {"mimetype", "META-INF/container.xml"} <= names:
        return "epub"
    raise UnsupportedFormatError("an archive, but neither DOCX nor EPUB")


def formats(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, format, code, message) of each file: a bad file is a row that says so, never a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str, str | None]] = []
            for value in batch.column(1):
                try:
                    out.append((sniff(value.as_py() or b"", limits), "ok", None))
                except (IngestionError, UnsafeArchiveError) as e:
                    out.append((None, e.code, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ([], [], [])))], names=["path", "format", "code", "message"])

    known = files.select("path", "content").mapInArrow(run, STATUS)
    kinds = files.select(F.col("path").alias("__path"), describe(F.col("content")).alias("__kind"))
    plain = F.when((F.col("code") == "unsupported") & (F.col("__kind") != "zip"), F.col("__kind")).otherwise(F.col("message"))
    return known.join(kinds, F.col("path") == F.col("__path")).select("path", "format", "code", plain.alias("message"))
