"""Paged documents as a data source: files of several pages and a table of contents, read in partitions of files."""

from __future__ import annotations

import fnmatch
import importlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from graphloom.functions import text as T
from graphloom.operators import chunking

#: (pages, contents) of a file's bytes: texts, and (level, title, page from 1)
Parsed = tuple[list[str], list[tuple[int, str, int]]]
KINDS = {
    "pages": pa.schema([("path", pa.string()), ("page_idx", pa.int32()), ("text", pa.string()), ("n_pages", pa.int32())]),
    "contents": pa.schema([("path", pa.string()), ("idx", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("page_1", pa.int64()), ("n_pages", pa.int32())]),
}
DDL = {"pages": "path string, page_idx int, text string, n_pages int", "contents": "path string, idx int, level int, title string, page_1 long, n_pages int"}
# Fixed value: the title of a document without contents.
UNTITLED = "Main Content"
OPEN = 32 << 10  # what opening a file costs, in bytes read meanwhile
_HEADING = re.compile(r"(?m)^(#{1,12})[ \t]+(\S.*)$")


def parse_text(data: bytes) -> Parsed:
    """Text files: pages end with form feeds, lines that begin with number signs and a blank are headings, their level the number of signs. Bytes that aren't UTF-8 are replaced."""
    pages = data.decode("utf-8", "replace").split("\f")
    return pages, [(len(m[1]), m[2].strip(), at) for at, page in enumerate(pages, 1) for m in _HEADING.finditer(page)]


def _loaded(name: str) -> Callable[[bytes], Parsed]:
    if name == "text":
        return parse_text
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Files(InputPartition):
    """Files that one task reads, in order."""

    paths: list[str]


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern, self.kind = options["path"], options.get("pattern", "*"), options.get("what", "pages")
        self.parser, self.most, self.only = options.get("parser", "text"), int(options.get("bytesatask", 32 << 20)), None
        if self.kind not in KINDS:
            raise ValueError(f"what is pages or contents, not {self.kind}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Paths asked for are all that is opened; the rest of the filters is left to the engine."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files by path, together as long as they are small: a task takes files of bytesatask, to which each adds OPEN for being opened; a larger file is a task's own."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        found = store.get_file_info(base) if store.get_file_info(base).type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        found = sorted((x.path, x.size or 0) for x in (found if isinstance(found, list) else [found]) if x.type == fs.FileType.File)
        parts, held = [], self.most + 1
        for path, size in found:
            name = path.rsplit("/", 1)[-1]
            if name.startswith(("_", ".")) or not fnmatch.fnmatch(name, self.pattern) or self.only is not None and prefix + path not in self.only:
                continue
            if held + size > self.most:
                parts.append([])
                held = 0
            parts[-1].append(prefix + path)
            held += size + OPEN
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        parse, schema = _loaded(self.parser), KINDS[self.kind]
        for path in partition.paths:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as file:
                pages, contents = parse(file.read())
            if self.kind == "pages":
                rows = [(path, i, t, len(pages)) for i, t in ((i, t.strip()) for i, t in enumerate(pages)) if t]
            else:
                rows = [(path, i, level, title, page, len(pages)) for i, (level, title, page) in enumerate(contents or [(1, UNTITLED, 1)])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class PagedDocuments(DataSource):
    """Format paged_documents. Options: path (a file or a folder, searched deep), pattern (of file names), what (pages or contents), parser (text, or module:function of bytes to Parsed), bytesatask."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return DDL[self.options.get("what", "pages")]

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def read_documents(spark: SparkSession, path: str, what: str = "pages", pattern: str = "*", parser: str = "text") -> DataFrame:
    """pages: (path, page_idx, text, n_pages) of every page that isn't blank; contents: (path, idx, level, title, page_1, n_pages), one entry UNTITLED where a file has none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDocuments)
    return spark.read.format("paged_documents").option("what", what).option("pattern", pattern).option("parser", parser).load(path)


def _files_written(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}") as file:
                    file.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_documents(files: DataFrame, path: str) -> int:
    """Writes each row of files (name, text) as a file of its own in the folder path; their number. Rows of a null name or text are left out.

    Tasks write under the names given, so no file is moved when they end, and a task that is tried again writes the same files; one name in two rows is the caller's error."""
    rows = files.select("name", "text").filter("name is not null and text is not null")
    return rows.mapInArrow(_files_written(path), "n long").agg(F.sum("n")).first()[0] or 0


def sections_read(spark: SparkSession, path: str, pattern: str = "*", parser: str = "text") -> DataFrame:
    """(path, page_idx, text, id, level, title, ata, page_start, page_end): every page of every file with the deepest section that spans it."""
    contents = read_documents(spark, path, "contents", pattern, parser).withColumnRenamed("path", "doc")
    sections = chunking.toc_ends(contents.withColumn("last_page", F.col("n_pages").cast("long") - 1), None)
    pages = read_documents(spark, path, "pages", pattern, parser).select(F.col("path").alias("doc"), "page_idx", "text")
    placed = chunking.pages_to_sections(pages, sections)
    named = sections.select("doc", F.col("idx").alias("section_idx"), "id", "level", "title", T.guess_chapter(F.col("title")).alias("ata"), "page_start", "page_end")
    return placed.join(named, ["doc", "section_idx"]).drop("section_idx").withColumnRenamed("doc", "path")
