"""S1 ``scan_files``: document bytes with their file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.files import basename


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``binaryFile`` scan -> ``(path, filename, length, content, modificationTime)``.

    All files are rows; one over the size limit becomes a reject row further on
    (P3). Where only names and lengths are selected, contents stay unread.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", basename(F.col("path")).alias("filename"), "length", "content", "modificationTime")


def files_from_table(df: DataFrame) -> DataFrame:
    """Adapt a ``(doc_id, filename, content STRING|BINARY, n_bytes)`` table to the scan schema."""
    content = F.col("content")
    if dict(df.dtypes).get("content") == "string":
        content = F.encode(content, "UTF-8")
    length = F.col("n_bytes") if "n_bytes" in df.columns else F.octet_length(content)
    return df.select("doc_id", F.col("filename").alias("path"), basename(F.col("filename")).alias("filename"),
                     length.cast("bigint").alias("length"), content.alias("content"))
