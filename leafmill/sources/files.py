"""Files as sources: folders of any depth, plain text, office containers, and the texts of their pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, markup, quality
from ..functions.text import lines_normalised

# Which files are read, by extension.
TEXT = """.txt .md .markdown .csv .tsv .json .jsonl .xml .html .htm .css .js .jsx .ts .tsx .py .java .c .cpp .h .hpp .cs .go .rs .php
.rb .sql .yaml .yml""".split()
OFFICE = ".docx .pptx .xlsx .odt .odp .ods".split()
IMAGES = ".png .jpg .jpeg .bmp .gif .tif .tiff .webp".split()
OTHER = ".pdf .doc .rtf".split()
#: Parts of each container that hold text.
PARTS = {
    ".docx": r"^word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$", ".pptx": r"^ppt/(slides|notesSlides)/[^/]+\.xml$",
    ".xlsx": r"^xl/(sharedStrings|worksheets/[^/]+)\.xml$", ".odt": r"^content\.xml$", ".odp": r"^content\.xml$", ".ods": r"^content\.xml$",
}


def scan(spark: SparkSession, path: str | list[str], extensions: list[str] | None = None) -> DataFrame:
    """path, file_name, extension, size, modified, content of files below path (or of the files named)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = identity.extension(F.col("path"))
    return rows.filter(ext.isin(*(extensions or TEXT + OFFICE + IMAGES + OTHER))).select(
        "path", identity.base_name(F.col("path")).alias("file_name"), ext.alias("extension"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "content")


def identified(files: DataFrame) -> DataFrame:
    """files with file_hash and document_id."""
    return files.withColumn("file_hash", identity.file_hash(F.col("content"))).withColumn("document_id", identity.document_id(F.col("file_hash")))


def plain_text(content: Column) -> Column:
    """Empty if there is a zero byte."""
    text = F.decode(content, "UTF-8")
    return F.when(F.contains(content, F.lit(b"\0")), "").otherwise(lines_normalised(text))


def natural(name: str) -> list:
    """slide2 comes before slide10."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def container_parts(files: DataFrame) -> DataFrame:
    """path, part_no, xml, error: the text parts of office containers, in natural order. Unreadable files give one row
    with an error."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, ext, content in zip(pdf["path"], pdf["extension"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = sorted((n for n in z.namelist() if re.search(PARTS[ext], n)), key=natural)
                        out += [(path, i, z.read(n).decode("utf-8", "replace"), None) for i, n in enumerate(names)]
                except (zipfile.BadZipFile, KeyError, RuntimeError, OSError) as e:
                    out.append((path, 0, "", str(e)))
            yield pd.DataFrame(out, columns=["path", "part_no", "xml", "error"])

    return files.filter(F.col("extension").isin(*PARTS)).select("path", "extension", "content").mapInPandas(
        run, "path string, part_no int, xml string, error string")


def extracted(files: DataFrame) -> DataFrame:
    """path, text, error for text files and office containers; other files give an empty text and no error."""
    plain = files.filter(F.col("extension").isin(*TEXT)).select("path", plain_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    parts = container_parts(files).withColumn("text", markup.markup_text(F.col("xml")))
    office = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part_no", "text"))).alias("_p"), F.max("error").alias("error"))
    office = office.select("path", F.array_join(F.filter(F.transform("_p", lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("text"), "error")
    rest = files.filter(~F.col("extension").isin(*TEXT, *PARTS)).select("path", F.lit("").alias("text"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(office).unionByName(rest)


def pages_and_jobs(pages: DataFrame, first: int = 3, least: int = 25) -> tuple[DataFrame, DataFrame]:
    """Pages to index now (number up to `first`) and jobs for the rest; a page needs recognition if it has under `least`
    characters or an image."""
    needs = (F.length(F.trim("text")) < least) | F.col("has_image")
    now = pages.filter(F.col("page_number") <= first).withColumns({"page_id": identity.page_id(F.col("document_id"), F.col("page_number")), "needs_recognition": needs, "status": F.lit("done")})
    later = pages.filter(F.col("page_number") > first).select(
        identity.job_id(F.col("document_id"), F.col("page_number")).alias("job_id"), "document_id", "page_number", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return now, later


def page_texts(pages: DataFrame, least: int = 25) -> DataFrame:
    """pages (embedded, recognised, has_image) with needs_recognition, text and quality columns: recognised text counts
    where the embedded one has under `least` characters or the page has an image, after an empty line."""
    rows = pages.withColumn("embedded", F.coalesce("embedded", F.lit(""))).withColumn("needs_recognition", (F.length("embedded") < least) | F.col("has_image"))
    read = F.when(F.col("needs_recognition"), F.nullif(F.col("recognised"), F.lit("")))
    return quality.built(rows.withColumn("text", lines_normalised(F.concat_ws("\n\n", F.nullif(F.col("embedded"), F.lit("")), read))))


def page(pages: DataFrame, document_id: str, number: int) -> DataFrame:
    """One page of a document. The query fails where the document has no such page."""
    own = pages.filter(F.col("document_id") == document_id)
    last = own.agg(F.coalesce(F.max("page_number"), F.lit(0)).alias("last"))  # one row
    fits = F.when(F.lit(number).between(F.lit(1), F.col("last")), True).otherwise(F.raise_error(F.concat(F.lit(f"page {number} is not in 1 to "), F.col("last").cast("string"))))
    return last.filter(fits).join(own.filter(F.col("page_number") == number))


def scanned(files: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(what classify makes of the texts of readable files, the others with their error)."""
    found = identified(files).drop("content").join(extracted(files), "path")
    return classify(found.filter("error is null").drop("error")), found.filter("error is not null")
