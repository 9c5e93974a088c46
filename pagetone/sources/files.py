"""Files in and findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetone.operators.intake import ACCEPTED
from pagetone.operators.tokens import stream_text


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of documents under a folder; the content is never read."""
    names = "*.{" + ",".join(sorted({*ACCEPTED, *(e.upper() for e in ACCEPTED)})) + "}"
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", names).load(folder).select("path", "length"))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Content streams stored as files, one row each."""
    return (spark.read.format("binaryFile").load(folder)
            .select("path", "length", stream_text(F.col("content")).alias("text")))


def _bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def write_findings(findings: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 8) -> None:
    """Persist findings by document bucket, so that one document is found without reading the others.

    Rows meet by bucket and a salt of the page, so there are at most ``buckets * files_per_bucket`` files,
    however many tasks hold rows, and a hot document spreads over the files of its bucket.
    """
    salt = F.pmod(F.xxhash64("doc_id", "page_no"), F.lit(files_per_bucket))
    (findings.withColumn("doc_bucket", _bucket(F.col("doc_id"), buckets)).repartition("doc_bucket", salt)
     .write.mode("overwrite").partitionBy("doc_bucket").parquet(path))


def read_findings(spark: SparkSession, path: str, doc_ids: list[int] | None = None, buckets: int = 64) -> DataFrame:
    """All findings, or those of ``doc_ids``: then only their buckets are read. ``buckets`` as when written."""
    found = spark.read.parquet(path)
    if doc_ids is not None:
        wanted = F.lit(False)
        for doc_id in doc_ids:
            key = F.lit(doc_id).cast("bigint")
            wanted = wanted | ((F.col("doc_bucket") == _bucket(key, buckets)) & (F.col("doc_id") == key))
        found = found.filter(wanted)
    return found.drop("doc_bucket")
