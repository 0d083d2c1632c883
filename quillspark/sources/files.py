"""Text files as documents, read by Spark from any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``file_path, file_name, file_size_bytes, checksum_sha256, text, warning`` of each file.

    Bytes that aren't UTF-8 are read as Latin-1, with a warning; CRLF and CR become LF.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(
        F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("checksum_sha256"),
        F.regexp_replace(text, "\r\n?", "\n").alias("text"), F.when(~utf8, "UTF-8 decode failed; used latin-1 fallback encoding.").alias("warning"),
    )


def new_documents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of found whose checksum isn't stored, the least path of each checksum."""
    fresh = found.join(stored.select("checksum_sha256"), "checksum_sha256", "left_anti")
    return fresh.groupBy("checksum_sha256").agg(F.min_by(F.struct(*[c for c in found.columns if c != "checksum_sha256"]), "file_path").alias("_r")).select("checksum_sha256", "_r.*").select(*found.columns)


def safe_name(name: Column) -> Column:
    """A name to store an upload under, characters that file systems forbid replaced by _; null for an empty name or one that has .. or a path."""
    clean = F.trim(F.regexp_replace(name, r'[<>:"|?*\\/\x00-\x1f]', "_"))
    return F.when((name != "") & ~name.contains("..") & ~name.rlike(r"[/\\]"), F.when(clean.isin("", "."), "upload.bin").otherwise(clean))
