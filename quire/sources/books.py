"""Book files as tables, chapters as files again, and whether nothing else changed."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import file_name, slug, web_slug
from ..operators import toc
from . import docx, epub
from .archives import IngestionError, Limits, UnsafeArchiveError, sniff
from .blocks import completed, isolation
from .tables import written

_BLOCK = "index: int, tag: string, is_paragraph: boolean, is_table: boolean, text: string, is_empty: boolean, word_count: int, style_id: string, style_level: int, bold: boolean, all_caps_prop: boolean, max_size: int, alignment: string, page_break_before: boolean, num: struct<num_id:int,ilvl:int>, anchor_id: string, starts_page: boolean, starts_section: boolean, starts_spine: boolean"
PARSED = f"doc_id long, path string, format string, code string, message string, title string, blocks array<struct<{_BLOCK}>>, bookmarks array<struct<index:int,anchor:string>>, links array<struct<ord:int,anchor:string,title:string,level:int>>, field array<struct<ord:int,title:string>>, nav array<struct<ord:int,title:string,level:int,href:string>>, files array<struct<file:string,index:int>>, anchors array<struct<file:string,anchor:string,index:int>>"
_PARTS = ("blocks", "bookmarks", "links", "field", "nav", "files", "anchors")


def book_id(path: Column) -> Column:
    """A document's id from its whole path: files of one name in different folders are different books."""
    return F.xxhash64(path)


def parsed(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each file (path, content) with all that detection needs; a file that can't be read has a code and a message."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(PARSED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, path, value in zip(*(batch.column(k) for k in range(3)), strict=True):
                row: dict = {"doc_id": doc.as_py(), "path": path.as_py(), "code": "ok"}
                try:
                    content = value.as_py() or b""
                    row["format"] = sniff(content, limits)
                    row |= (docx if row["format"] == "docx" else epub).parse(content)
                except (IngestionError, UnsafeArchiveError) as e:
                    row |= {"code": e.code, "message": str(e)}
                except Exception as e:  # a malformed part: this book's failure, not the job's
                    row |= {"code": "malformed", "message": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([{name: row.get(name) for name in arrow.names}], schema=arrow)

    return files.select(book_id(F.col("path")).alias("doc_id"), "path", "content").mapInArrow(run, schema)


@dataclass(frozen=True)
class Books:
    """status (doc_id, path, format, code, message, title), blocks, and toc_entries (doc_id, index, title, level)."""

    status: DataFrame
    blocks: DataFrame
    toc_entries: DataFrame
    titles: DataFrame


def read_books(files: DataFrame, limits: Limits = Limits()) -> Books:
    """Files (path, content) to what segment() takes. The files are parsed once, into a table."""
    rows = written(parsed(files, limits), "parsed")
    part = {name: rows.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*") for name in _PARTS}
    blocks = completed(isolation(part["blocks"]))
    anchored = toc.resolve_anchors(part["bookmarks"], part["links"], part["blocks"])
    field = part["field"].join(anchored.select("doc_id").distinct(), "doc_id", "left_anti")
    heads = part["blocks"].where("is_paragraph and style_level is not null").select("doc_id", "index", "text", "style_level")
    listed = toc.resolve_field(field, heads).drop("ratio")
    linked = toc.resolve_hrefs(part["nav"], part["files"], part["anchors"])
    columns = ["doc_id", "index", "title", "level"]
    entries = anchored.select(columns).unionByName(listed.select(columns)).unionByName(linked.select(columns))
    status = rows.select("doc_id", "path", "format", "code", "message", "title")
    return Books(status, blocks, written(entries, "toc"), status.select("doc_id", F.coalesce("title", F.lit("")).alias("title")))


def chapter_names(chapters: DataFrame, status: DataFrame, pattern: str | None = None) -> DataFrame:
    """chapters with format and file: by the pattern, or NN_slug with the format's extension."""
    rows = chapters.join(status.select("doc_id", "format", "path"), "doc_id")
    number = F.lpad(F.col("ordinal").cast("string"), 2, "0")
    number = F.when(F.length(F.col("ordinal").cast("string")) > 2, F.col("ordinal").cast("string")).otherwise(number)
    plain = slug(F.col("title"), F.concat(F.lit("chapter_"), F.col("ordinal").cast("string")))
    web = web_slug(F.col("title"), F.concat(F.lit("chapter_"), number))
    if pattern:
        name = F.when(F.col("format") == "docx", file_name(F.col("ordinal"), F.col("title"), ".docx", pattern)).otherwise(file_name(F.col("ordinal"), F.col("title"), ".epub", pattern))
    else:
        name = F.when(F.col("format") == "docx", F.concat(number, F.lit("_"), plain, F.lit(".docx"))).otherwise(F.concat(number, F.lit("_"), web, F.lit(".epub")))
    return rows.withColumns({"file": name, "slug": F.when(F.col("format") == "docx", plain).otherwise(web)})


def chapter_files(files: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, ordinal, file, title, level, confidence, start, end, data): each chapter as a file of its book's format.

    named: chapter_names(). A book's content goes to its chapters once; chapters without blocks have no file.
    """
    wanted = named.where("end > start").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "file", "title", "level", "confidence", "start", "end", "slug", "format"))).alias("chapters"))
    rows = files.select(book_id(F.col("path")).alias("doc_id"), "content").join(wanted, "doc_id").select("doc_id", "content", "chapters")
    schema = "doc_id long, ordinal int, file string, title string, level string, confidence double, start int, end int, data binary"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(1)[k].as_py()
                for ch in batch.column(2)[k].as_py():
                    data = docx.clone(content, ch["start"], ch["end"]) if ch["format"] == "docx" else epub.chapter(content, ch["start"], ch["end"], ch["title"], ch["slug"])
                    row = {"doc_id": batch.column(0)[k].as_py(), "data": data} | {n: ch[n] for n in names if n in ch}
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def manifest(named: DataFrame) -> DataFrame:
    return named.where("end > start").select("doc_id", "file", "title", "level", "confidence", F.array("start", "end").alias("blocks"))


def save_files(made: DataFrame, folder: str) -> DataFrame:
    """Writes chapter files to folder/<doc_id>/<file>, a folder that all executors mount; returns (doc_id, file, size).

    A file is written under another name first and then moved, so a task that runs twice leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["doc_id", "file", "data"]).to_pylist()
            for r in rows:
                place = os.path.join(folder, str(r["doc_id"]))
                os.makedirs(place, exist_ok=True)
                part = os.path.join(place, f".{r['file']}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(r["data"])
                os.replace(part, os.path.join(place, r["file"]))
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["file"] for r in rows]), pa.array([len(r["data"]) for r in rows], pa.int64())], names=["doc_id", "file", "size"])

    return made.mapInArrow(run, "doc_id long, file string, size long")


def members(archives: DataFrame, data: str) -> DataFrame:
    """archives with a row for each member: name, sha1, and for the main part whether section properties come last."""
    keep = [c for c in archives.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                with zipfile.ZipFile(io.BytesIO(value.as_py())) as z:
                    parts = [(n, z.read(n)) for n in z.namelist()]
                out.append([{"name": n, "sha1": hashlib.sha1(d).hexdigest(), "section": docx.slices(d)[3] is not None if n == docx.MAIN else None} for n, d in parts])
            kind = pa.list_(pa.struct([("name", pa.string()), ("sha1", pa.string()), ("section", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*keep, "parts"])

    fields = ", ".join(f"`{c}` {archives.schema[c].dataType.simpleString()}" for c in keep)
    rows = archives.select(*keep, data).mapInArrow(run, f"{fields}, parts array<struct<name:string,sha1:string,section:boolean>>")
    return rows.select(*keep, F.explode("parts").alias("p")).select(*keep, "p.*")


def verify(files: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, file, same_parts, bytes_preserved, has_section, ok): of DOCX chapters, whether all parts but the main one are those
    of the book, and whether the main one keeps its section properties."""
    source = members(files.select(book_id(F.col("path")).alias("doc_id"), "content"), "content").select("doc_id", "name", F.col("sha1").alias("__sha1"))
    own = members(made.where(F.endswith("file", F.lit(".docx"))).select("doc_id", "file", "data"), "data")
    wanted = own.select("doc_id", "file").distinct().join(source, "doc_id")
    both = own.join(wanted, ["doc_id", "file", "name"], "full_outer")
    main = F.col("name") == docx.MAIN
    checks = both.groupBy("doc_id", "file").agg(
        F.bool_and(F.col("sha1").isNotNull() & F.col("__sha1").isNotNull()).alias("same_parts"),
        F.bool_and(main | F.coalesce(F.col("sha1") == F.col("__sha1"), F.lit(False))).alias("bytes_preserved"),
        F.coalesce(F.bool_or(main & F.coalesce("section", F.lit(False))), F.lit(False)).alias("has_section"),
    )
    return checks.withColumn("ok", F.col("same_parts") & F.col("bytes_preserved") & F.col("has_section"))
