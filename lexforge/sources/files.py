"""Documents from files of several kinds. Failures become rows of their own, never a lost job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_label

#: File endings and what they hold.
KINDS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "txt": "txt", "md": "markdown"}
SCHEMA = "path string, content string, page_number int, total_pages int, file_type string, timestamp long, paragraph_count int, slide_count int, char_count int, error string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

_pdf_reader: Callable[[bytes], list[str]] | None = None


def use_pdf_reader(reader: Callable[[bytes], list[str]] | None) -> None:
    """Plug in a function from a PDF's bytes to its pages' texts; without one PDFs are reported as errors."""
    global _pdf_reader
    _pdf_reader = reader


_page_reader: Callable[[bytes, int], str] | None = None


def use_page_reader(reader: Callable[[bytes, int], str] | None) -> None:
    """Plug in a function from a PDF's bytes and a page's number (from 1) to its text, for pages without any: scans.
    Without one such pages have an empty text."""
    global _page_reader
    _page_reader = reader


def docx_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{WORD}body")
    return ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in (body.findall(f"{WORD}p") if body is not None else [])]


def pptx_slides(data: bytes) -> list[str]:
    """Each slide's paragraphs, a line each, in the order of slides' numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = [n for n in parts.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        names.sort(key=lambda n: int("".join(c for c in n.rsplit("/", 1)[1] if c.isdigit()) or 0))
        roots = [ElementTree.fromstring(parts.read(n)) for n in names]
    lines = [["".join(t.text or "" for t in p.iter(f"{DRAWING}t")) for p in root.iter(f"{DRAWING}p")] for root in roots]
    return ["\n".join(x for x in slide if x) for slide in lines]


def plain_text(data: bytes) -> str:
    """UTF-8, else GBK; anything else is an error."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gbk")


def _rows(path: str, data: bytes, kind: str, time: int, reader, scans=None) -> Iterator[dict]:
    row = {"path": path, "file_type": kind, "timestamp": time}
    if kind == "pdf":
        if reader is None:
            raise RuntimeError("no PDF reader is plugged in")
        pages = reader(data)
        for k, text in enumerate(pages, 1):
            text = scans(data, k) if scans and not text.strip() else text
            yield {**row, "content": text, "page_number": k, "total_pages": len(pages)}
    elif kind == "docx":
        paragraphs = [p for p in docx_paragraphs(data) if p.strip()]
        yield {**row, "content": "\n".join(paragraphs), "paragraph_count": len(paragraphs)}
    elif kind == "pptx":
        slides = pptx_slides(data)
        yield {**row, "content": "\n".join(slides), "slide_count": len(slides)}
    else:
        text = plain_text(data) if kind == "txt" else data.decode("utf-8")
        yield {**row, "content": text, "char_count": len(text)}


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of all files below ``folder`` with a known ending; a missing folder gives none.

    Files are read by Spark's own reader, so ``folder`` may lie in any store. The decoding is
    Python's, since the JVM's decoder lacks GBK; each task streams its files.
    """
    columns = dict(x.split() for x in SCHEMA.split(", "))
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        empty = spark.createDataFrame([], SCHEMA + ", source string")
        return empty.drop("error"), empty.select("path", "error")
    ending = "|".join(KINDS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(rf"(?i)\.(?:{ending})$"))
    reader, scans = _pdf_reader, _page_reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, data, time in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += _rows(path, data, KINDS[path.rsplit(".", 1)[1].lower()], int(time), reader, scans)
                except Exception as e:  # one bad file is a row of failures
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], types[k]) for c, k in columns.items()], names=list(columns))

    rows = files.select("path", "content", F.unix_timestamp("modificationTime").alias("time")).mapInArrow(run, SCHEMA)
    good = rows.where("error is null and content is not null and content <> ''").drop("error")
    return good.withColumn("source", source_label(F.col("path"), folder.split("://")[-1])), rows.where("error is not null").select("path", "error")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """With a schema: nothing is inferred, and an absent key is null."""
    return spark.read.schema(schema).json(path)
