"""Plain-text sources: bytes to clean text, and which files may come in at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import first_match, strip

# The 0x80-0x9F range of Windows-1252 in code order (U+FFFD where undefined).
WINDOWS_1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
CONTROL_RANGE = "".join(chr(code) for code in range(0x80, 0xA0))


def decode_text(content: Column) -> Column:
    """UTF-8 (with or without byte-order mark), else Windows-1252; line ends as \\n; trimmed."""
    as_utf8 = content.cast("string")
    fallback = F.translate(F.decode(content, "ISO-8859-1"), CONTROL_RANGE, WINDOWS_1252)
    text = F.when(F.is_valid_utf8(as_utf8), F.regexp_replace(as_utf8, "^﻿", "")).otherwise(fallback)
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(filename, page, text) of every non-empty text file below a path; each file is one page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(1).alias("page"),
                        decode_text(F.col("content")).alias("text")).where("text <> ''")


def file_extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"[^.]\.([^./]*)$", 1)


def with_reject_reason(files: DataFrame) -> DataFrame:
    """Adds why a file (name, size) is refused; null when it is admitted."""
    return files.withColumn("reject_reason", first_match([
        (~file_extension(F.col("name")).isin(*V.ALLOWED_EXTENSIONS), "unsupported type"),
        (F.col("size") == 0, "empty"),
        (F.col("size") > V.MAX_UPLOAD_BYTES, "too large")]))


def admit_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted files, quarantine with reasons)."""
    checked = with_reject_reason(files)
    return checked.where("reject_reason IS NULL").drop("reject_reason"), checked.where("reject_reason IS NOT NULL")


def document_key(name: Column, content: Column) -> Column:
    """Stable id: slug of the file stem (40 characters) and ten characters of the content hash."""
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(F.sha2(content, 256), 1, 10))
