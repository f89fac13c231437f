"""Sources: HTML, files by kind, DOCX; admission; identity of file sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dialect import js_trim
from ..functions.ocr_text import normalize
from ..session import ship_package

#: Largest file that is admitted, and pages that are read of a PDF.
MAX_BYTES, MAX_PAGES = 8 * 1024 * 1024, 50
_TEXT = r"\.(?:txt|csv|json|md|log)$"
_IMAGE = r"\.(?:jpe?g|png|gif|bmp|webp|tiff?)$"


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags become blanks; six entities are decoded, ``&amp;`` before ``&lt;``."""
    out = F.regexp_replace(html, r"(?i)<script\b[^>]*>[\s\S]*?</script>", " ")
    out = F.regexp_replace(out, r"(?i)<style\b[^>]*>[\s\S]*?</style>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, character in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'")):
        out = F.regexp_replace(out, entity, character)
    return out


def file_route(name: Column, mime: Column) -> Column:
    """How a file is read, by the first rule that fits: html, text, pdf, docx, image or unsupported."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(F.rlike(n, F.lit(r"\.html?$")) | (m == "text/html"), "html")
        .when(F.rlike(n, F.lit(_TEXT)) | m.startswith("text/"), "text")
        .when(n.endswith(".pdf") | (m == "application/pdf"), "pdf")
        .when(n.endswith(".docx") | (m == "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), "docx")
        .when(m.startswith("image/") | F.rlike(n, F.lit(_IMAGE)), "image")
        .otherwise("unsupported")
    )


def admitted(name: Column, mime: Column, size: Column) -> Column:
    """Whether a file is of a kind that can be read, and small enough."""
    return (file_route(name, mime) != "unsupported") & (size <= MAX_BYTES)


def file_set_key(df: DataFrame, keys: list[str], name: str, kind: str, size: str, modified: str) -> DataFrame:
    """keys, file_set: the sorted signatures of a set of files, one a line."""
    signature = F.to_json(F.struct(F.col(name).alias("name"), F.col(kind).alias("type"), F.col(size).alias("size"), F.col(modified).alias("lastModified")))
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(signature)), "\n").alias("file_set"))


def accumulate_by_name(df: DataFrame, keys: list[str], name: str, arrival: str, keep: str = "last") -> DataFrame:
    """One file of each name: the one that came last, or first."""
    order = F.desc(arrival) if keep == "last" else F.asc(arrival)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys, name).orderBy(order))).where("_n = 1").drop("_n")


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def docx_text(data: bytes) -> tuple[str, list[str]]:
    """Paragraphs of a DOCX, two line breaks after each, and warnings; unreadable files give no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except Exception as e:  # any damage to the archive or its XML
        return "", [f"unreadable DOCX: {type(e).__name__}"]
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    parts = []
    for paragraph in root.iter(f"{w}p"):
        text = []
        for node in paragraph.iter():
            if node.tag == f"{w}t":
                text.append(node.text or "")
            elif node.tag == f"{w}tab":
                text.append("\t")
            elif node.tag == f"{w}br":
                text.append("\n")
        parts.append("".join(text))
    return "\n\n".join(parts).strip(), []


def pdf_text(data: bytes) -> tuple[str, list[str]]:
    """Pages' texts, trimmed, blank ones dropped, an empty line between them; needs pypdf, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return "", ["no PDF reader is installed"]
    try:
        pages = [" ".join((p.extract_text() or "").split("\n")).strip() for p in PdfReader(io.BytesIO(data)).pages[:MAX_PAGES]]
        return "\n\n".join(p for p in pages if p), []
    except Exception as e:
        return "", [f"unreadable PDF: {type(e).__name__}"]


def read_files(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], tuple[str, list[str]]]] | None = None) -> DataFrame:
    """path, label, route, text, warnings of every admitted file in a folder. Size and name are looked at before content is read.

    readers: functions for routes ``pdf``, ``docx`` and ``image``; without one for images their text is empty.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).withColumn("label", F.element_at(F.split("path", "/"), -1))
    return extract(files.where(admitted(F.col("label"), F.lit(None).cast("string"), F.col("length"))).withColumn("mime", F.lit(None).cast("string")), readers)


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], tuple[str, list[str]]]] | None = None) -> DataFrame:
    """files: path, label, mime, content. Texts of images are normalised; blank texts stay, for the caller to drop."""
    use = {"pdf": pdf_text, "docx": docx_text} | (readers or {})
    routed = files.select("path", "label", file_route(F.col("label"), F.col("mime")).alias("route"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, warnings = [], []
            for route, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if route in ("html", "text"):
                    text, warned = (content or b"").decode("utf-8", "replace"), []
                elif route in use:
                    text, warned = use[route](content or b"")
                else:
                    text, warned = "", [] if route == "image" else ["unsupported file type"]
                texts.append(text)
                warnings.append(warned)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(warnings, pa.list_(pa.string()))], ["path", "label", "route", "text", "warnings"])

    got = routed.mapInArrow(run, "path string, label string, route string, text string, warnings array<string>")
    text = F.when(F.col("route") == "html", html_to_text(F.col("text"))).when(F.col("route") == "image", normalize(F.col("text"))).otherwise(F.col("text"))
    return got.withColumn("text", js_trim(text))


def extract_once(files: DataFrame, same: list[str], readers: dict[str, Callable[[bytes], tuple[str, list[str]]]] | None = None) -> DataFrame:
    """``extract`` for files of which many are alike: those with equal ``same`` (columns such as label, length and time) are read once.

    files: path, label, mime, content and the columns of same. Rows of the result are those of files; nulls in same count as equal.
    Contents are shuffled once, by the key; the texts come back by a join on it.
    """
    keyed = files.withColumn("_key", F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256))
    first = keyed.groupBy("_key").agg(F.min_by(F.struct("label", "mime", "content"), "path").alias("_f"))
    read = extract(first.select(F.col("_key").alias("path"), "_f.label", "_f.mime", "_f.content"), readers)
    texts = read.select(F.col("path").alias("_key"), "route", "text", "warnings")
    return keyed.select("path", "label", "_key").join(texts, "_key").select("path", "label", "route", "text", "warnings")


def parse_dict(text: str) -> list[str]:
    """One entry a line; Windows line ends, entries of white space, and one empty line at the end are allowed for."""
    lines = re.split("\r?\n", text)
    return lines[:-1] if lines and lines[-1] == "" else lines
