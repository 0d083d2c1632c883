"""Readers of word-processor files and pages. Files are read by Spark from any store; each is parsed whole in one task, as its format demands."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import layout
from quillspark.sources.files import read_text_files

# The namespaces of the formats and the properties that are kept, by their name there.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PROPERTIES = (
    ("author", "creator"), ("category", "category"), ("comments", "description"), ("content_status", "contentStatus"), ("created", "created"), ("identifier", "identifier"), ("keywords", "keywords"),
    ("language", "language"), ("last_modified_by", "lastModifiedBy"), ("last_printed", "lastPrinted"), ("modified", "modified"), ("revision", "revision"), ("subject", "subject"), ("title", "title"), ("version", "version"),
)
SUFFIXES = (".pdf", ".docx", ".txt")
SCHEMA = "file_path string, file_name string, file_size_bytes long, checksum_sha256 string, text string, page_count int, metadata map<string,string>, warnings array<string>"
COLUMNS = ("file_path", "file_name", "file_size_bytes", "checksum_sha256", "text", "page_count", "metadata", "warnings")


def _said(element: ElementTree.Element) -> str:
    """The text of a paragraph; tabs and breaks are white space."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n"}
    return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in element.iter())


def _table(element: ElementTree.Element) -> str:
    cells = ([" ".join(_said(p) for p in cell.iter(f"{W}p")).strip() for cell in row.findall(f"{W}tc")] for row in element.findall(f"{W}tr"))
    return "\n".join(" | ".join(row) for row in cells)


def docx(content: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs and tables in order of the body, blank ones left out, between blank lines; and the properties that are set."""
    with zipfile.ZipFile(io.BytesIO(content)) as files:
        body = ElementTree.fromstring(files.read("word/document.xml")).find(f"{W}body")
        blocks = [_table(x) if x.tag == f"{W}tbl" else _said(x) for x in body if x.tag in (f"{W}p", f"{W}tbl")]
        core = ElementTree.fromstring(files.read("docProps/core.xml")) if "docProps/core.xml" in files.namelist() else []
    found = {x.tag.rsplit("}", 1)[-1]: x.text for x in core}
    return "\n\n".join(b.strip() for b in blocks if b.strip()), {name: found[tag] for name, tag in PROPERTIES if found.get(tag)}


def pdf(content: bytes) -> tuple[str, int, list[str]]:
    """Text of all pages between blank lines, their number, and a warning for each page without text. Needs the package pypdf."""
    import pypdf

    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(p for p in pages if p.strip()), len(pages), [f"Page {n} has no extractable text." for n, p in enumerate(pages, 1) if not p.strip()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, content in zip(batch.column("file_name").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                pages, known, warnings = None, {}, []
                if name.lower().endswith(".pdf"):
                    text, pages, warnings = pdf(content)
                else:
                    text, known = docx(content)
            except Exception as error:  # a file that can't be read is a row that says so
                text, pages, known, warnings = None, None, {}, [f"extraction failed: {type(error).__name__}"]
            rows.append((text, pages, list(known.items()), warnings))
        kept = [batch.column(c) for c in ("file_path", "file_name", "file_size_bytes", "checksum_sha256")]
        kinds = (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()))
        made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=list(COLUMNS))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files, DOCX and PDF files below a path, by suffix; others are left out. Page text gets its headings back (layout.repaired).

    ``file_path, file_name, file_size_bytes, checksum_sha256, text, page_count, metadata, warnings``; a file that can't be read has
    no text and a warning.
    """
    plain = read_text_files(spark, path)
    plain = plain.select("file_path", "file_name", "file_size_bytes", "checksum_sha256", "text", F.lit(None).cast("int").alias("page_count"), F.create_map().cast("map<string,string>").alias("metadata"), F.array_compact(F.array("warning")).alias("warnings"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,DOCX,pdf,PDF}").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("checksum_sha256"), "content")
    parsed = files.mapInArrow(_parse, SCHEMA)
    page = F.lower("file_name").endswith(".pdf")
    return plain.unionByName(parsed.withColumn("text", F.when(page, layout.repaired(layout.normal_ends(F.col("text")))).otherwise(F.col("text"))))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One file; a suffix other than .pdf, .docx and .txt is an error."""
    if not path.lower().endswith(SUFFIXES):
        raise ValueError(f"can't read {path}: the suffix must be one of {', '.join(SUFFIXES)}")
    return read_documents(spark, path)
