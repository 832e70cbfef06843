"""What a reader sees beside a document: kinds of files, labels of quality and confidence, short paths and previews; and
how tags and phrases are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import extension

# Kinds by extension, and the bounds of labels.
KINDS = {
    "pdf": ".pdf".split(), "image": ".png .jpg .jpeg .webp .bmp .gif .tif .tiff".split(),
    "office": ".doc .docx .pptx .xlsx .odt .odp .ods".split(),
    "code": ".js .jsx .ts .tsx .py .java .c .cpp .h .hpp .cs .go .rs .php .rb .swift .kt .sql .css .html".split(),
}
GOOD, FAIR = 85, 65
HIGH, LOW = 0.8, 0.55


def kind(path: Column) -> Column:
    """pdf, image, office, code, or else text."""
    ext = extension(path)
    out = F.lit("text")
    for name, exts in KINDS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def quality_label(quality: Column, status: Column) -> Column:
    q = F.coalesce(quality, F.lit(0))
    return F.when(status == "indexing", "Partial").when(q >= GOOD, "Good").when(q >= FAIR, "Review").otherwise("Low OCR")


def confidence_label(confidence: Column, review: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(review | (c < LOW), "Needs review").when(c >= HIGH, "High confidence").otherwise("Medium confidence")


def percent(confidence: Column) -> Column:
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5).cast("int")


def css_class(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), r"\s+", "-")


def short_path(path: Column) -> Column:
    """The first part and the last three of a path of more than four."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 4, path).otherwise(F.concat_ws("/", F.get(parts, 0), F.lit("..."), F.array_join(F.slice(parts, -3, 3), "/")))


def preview(clean: Column, text: Column, length: int = 320) -> Column:
    """The start of the clean text, or of the text where there is none."""
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), text, F.lit("")), 1, length)


def tag_form(tag: Column) -> Column:
    """A tag as users' tags are kept: signs that join words become blanks; a-z, digits, dots and plus signs stay."""
    joined = F.regexp_replace(F.lower(F.coalesce(tag, F.lit(""))), r"[#/\\_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9.+\s]+", " "), r"\s+", " "))


def phrase_form(phrase: Column) -> Column:
    """Lower case with single blanks, and no punctuation at either end."""
    one = F.trim(F.regexp_replace(F.lower(F.coalesce(phrase, F.lit(""))), r"\s+", " "))
    return F.regexp_replace(one, r"^[\s\-_:;,.()\[\]{}]+|[\s\-_:;,.()\[\]{}]+$", "")
